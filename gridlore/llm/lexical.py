"""Ranked lexical search with bit-sliced Bloom signatures.

The index holds documents in blocks.  A block is a matrix of bits: one row (slice) for each
position of a Bloom signature, one column for each document.  An entry of a signature is a
term together with a level: the term occurs LEVELS[level] times or more.  Blocks hold
documents with about the same number of entries, so their signatures are equally full.

A query reads, for each of its terms and levels, a few slices and takes their
conjunction: the documents that may have the term so often, no fewer than do.  The highest
level so found bounds the term's frequency, hence its part of the score; the weighted
sum over an item's terms bounds the document's score.  Two passes over the blocks follow:

* the documents with the highest bounds of any item are scored exactly, for all items; the last of an item's best
  ``top`` scores is a floor that the true ranking cannot fall below;
* every document whose bound reaches the floor is scored exactly, and the best are ranked.

No document is left out but by its bound.  Items are searched in groups of about ITEM_TERMS terms,
so what is broadcast and held by a task does not grow with their number.  Terms are compared byte by byte
where they are counted; hashes only place them in signatures.

Null texts have no terms, are in no count and are never ranked; the same holds of items, which then have no
rows.  Null ids are kept and rank after the others among equal scores.  Repeated rows of documents
count and rank each; repeated (id, text) rows of items are one item, and equal ids with different texts are ranked apart.
Empty tables give no rows.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridlore.llm.common import BASE, arrow_map, materialise, mix, read_table, row_hash, same_spans, slices, span_hashes, text_bytes, word_spans
from gridlore.llm.decontaminate import ALNUM, LOWER

TOP = 50
#: Frequencies that a signature tells apart.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Bits an entry and slices an entry: about one entry in 500 is seen where it is not.
BITS = 14
PROBES = 6
#: Entries of the documents of one block differ by this factor at most.
RATIO = 1.5
BLOCK_DOCS = 256
#: Bits of a block before packing, unless one document has more.
BLOCK_CELLS = 1 << 23
#: Terms of the items that are searched together, about.
ITEM_TERMS = 1 << 16
#: Documents to score are broadcast, 16 bytes each, up to this number; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Cells of (terms x documents) and (terms of items x documents) at a time.
CELLS = 1 << 21


def lowered(column: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, starts, ends, rows) of the words of a column."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    return data, *word_spans(data, offsets, is_word)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, terms): distinct terms of each different (id, text)."""
    narrow = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    narrow = narrow.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    kind = narrow.schema["item_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> dict:
        data, starts, ends, rows = lowered(part.column("text"), ALNUM)
        raw = data.tobytes()
        terms: list[set[str]] = [set() for _ in range(part.num_rows)]
        for r, s, e in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
            terms[r].add(raw[s:e].decode("utf-8"))
        return {"item": part.column("item"), "item_id": part.column("item_id"), "terms": pa.array([sorted(t) for t in terms], pa.list_(pa.string()))}

    return arrow_map(narrow, run, f"item long, item_id {kind}, terms array<string>", "text").where("size(terms) > 0")


@dataclass
class Query:
    """Terms of a group of items, in the order of their hashes, and which item has which."""

    seed: int
    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    items: np.ndarray
    #: Terms of all items, one item after the other, and where each begins.
    refs: np.ndarray
    first: np.ndarray
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0

    @staticmethod
    def of(rows: list[tuple[int, list[str]]]) -> Query:
        terms = sorted({t for _, ts in rows for t in ts})
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
        starts = ends - np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        seed = 0
        while len(np.unique(hashes := span_hashes(data, starts, ends, seed))) < len(terms):
            seed += 1
        order = np.argsort(hashes)
        place = {terms[k]: n for n, k in enumerate(order.tolist())}
        counts = [len(ts) for _, ts in rows]
        return Query(
            seed,
            hashes[order],
            data,
            starts[order],
            ends[order],
            np.array([i for i, _ in rows], np.int64),
            np.array([place[t] for _, ts in rows for t in ts], np.int64),
            np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
        )

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words that are terms of the group, the term of each)."""
        hashes = span_hashes(data, starts, ends, self.seed)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        on = np.flatnonzero(self.hashes[at] == hashes)
        at = at[on]
        same = same_spans(data, starts[on], ends[on], self.data, self.starts[at], self.ends[at])
        return on[same], at[same]

    def length_parts(self, lengths: np.ndarray) -> np.ndarray:
        """A document's m."""
        return 50 + (50 * lengths.astype(np.int64) * self.n_docs) // max(self.n_terms, 1)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, count) of the different pairs, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], np.diff(np.append(at, len(a)))


def level_hashes(hashes: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    return mix(hashes + BASE * np.asarray(level, np.uint64))


def slots(entries: np.ndarray, width: int) -> np.ndarray:
    """(entries, PROBES): slices of each entry."""
    step = mix(entries) | np.uint64(1)
    return np.stack([((entries + np.uint64(k) * step) % np.uint64(width)).astype(np.int64) for k in range(PROBES)], axis=1)


def pack(entries: list[np.ndarray]) -> tuple[int, bytes]:
    """(number of slices, their bits) of the documents with these entries."""
    width = max(len(e) for e in entries) * BITS
    bits = np.zeros((width, len(entries)), bool)
    doc = np.repeat(np.arange(len(entries)), [len(e) for e in entries])
    at = slots(np.concatenate(entries), width)
    bits[at, doc[:, None]] = True
    return width, np.packbits(bits, axis=1).tobytes()


INDEX = "width int, bits binary, doc_id array<long>, row_hash array<long>, length array<long>, term int, n long"


def build_index(docs: DataFrame, query: Query, id_col: str, text_col: str) -> DataFrame:
    """Blocks of the index, and rows (term, n): documents of a slice of the table with a term of the query.

    Blocks do not depend on the query; counting goes along to save a pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(query)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_hash(F.col(text_col)).alias("row_hash"))
    kinds = {"width": pa.int32(), "bits": pa.binary(), "doc_id": pa.list_(pa.int64()), "row_hash": pa.list_(pa.int64()), "length": pa.list_(pa.int64()), "term": pa.int32(), "n": pa.int64()}

    def rows(count: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(count, k) for c, k in kinds.items()], list(kinds))

    def block(held: list[tuple]) -> pa.RecordBatch:
        width, bits = pack([h[3] for h in held])
        column = lambda k, c: pa.array([[h[k] for h in held]], kinds[c])
        return rows(1, width=pa.array([width], pa.int32()), bits=pa.array([bits], pa.binary()), **{c: column(k, c) for k, c in enumerate(("doc_id", "row_hash", "length"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        levels = np.array(LEVELS)
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, of = lowered(part.column("text"), ALNUM)
                if not len(of):
                    continue
                on, term = q.find(data, starts, ends)
                found, df = np.unique(distinct_pairs(of[on], term)[1], return_counts=True)
                if len(found):
                    yield rows(len(found), term=pa.array(found, pa.int32()), n=pa.array(df, pa.int64()))
                doc, hashes, tf = distinct_pairs(of, span_hashes(data, starts, ends, q.seed))
                reach = np.searchsorted(levels, tf, side="right")  # levels that hold
                entry = level_hashes(np.repeat(hashes, reach), np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach))
                cuts = np.searchsorted(np.repeat(doc, reach), np.arange(part.num_rows + 1))
                lengths = np.bincount(of, minlength=part.num_rows)
                ids, prints = part.column("doc_id").to_pylist(), part.column("row_hash").to_pylist()
                for r in np.flatnonzero(lengths).tolist():
                    own = entry[cuts[r] : cuts[r + 1]]
                    size = int(math.log(len(own)) / math.log(RATIO))
                    mine = held.setdefault(size, [])
                    mine.append((ids[r], prints[r], int(lengths[r]), own.copy()))
                    most = max(1, min(BLOCK_DOCS, int(BLOCK_CELLS / (RATIO ** (size + 1) * BITS))))
                    if len(mine) >= most:
                        yield block(held.pop(size))
        for mine in held.values():
            yield block(mine)

    return narrow.mapInArrow(run, INDEX)


def bounds(width: int, bits: bytes, lengths: np.ndarray, query: Query, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(items, documents): no score of a document in the block is above this."""
    n = len(lengths)
    matrix = np.frombuffer(bits, np.uint8).reshape(width, (n + 7) // 8)
    active = np.arange(len(query.hashes))
    seen = None
    reached = np.zeros((len(query.hashes), n), np.uint8)
    for entries, steps in levels:
        e, s = entries[active], steps[active]
        rows = None
        for k in range(PROBES):
            some = matrix[((e + np.uint64(k) * s) % np.uint64(width)).astype(np.int64)]
            rows = some if rows is None else rows & some
        if seen is not None:
            rows &= seen
        on = rows.any(axis=1)
        active, seen = active[on], rows[on]
        if not len(active):
            break
        reached[active] += np.unpackbits(seen, axis=1)[:, :n]
    m = query.length_parts(lengths)
    most = np.array([0, *[b - 1 for b in LEVELS[1:]], 0], np.int64)[:, None] + np.zeros(n, np.int64)
    most[-1] = lengths
    parts = share(np.minimum(most, lengths), m)
    values = parts[reached, np.arange(n)] * query.weights[:, None]
    out = np.empty((len(query.items), n), np.int64)
    step = max(1, CELLS // n)
    first = 0
    while first < len(query.items):
        last = max(first + 1, int(np.searchsorted(query.first, query.first[first] + step, side="right")) - 1)
        own = query.refs[query.first[first] : query.first[last]]
        out[first:last] = np.add.reduceat(values[own], query.first[first:last] - query.first[first], axis=0)
        first = last
    return out


def parts_of(batch: pa.RecordBatch, query: Query, levels: list) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    """(bounds, ids, hashes) of a few documents at a time."""
    for k in range(batch.num_rows):
        width, bits = batch.column("width")[k].as_py(), batch.column("bits")[k].as_py()
        ids, prints, lengths = (batch.column(c)[k].values for c in ("doc_id", "row_hash", "length"))
        matrix = np.frombuffer(bits, np.uint8).reshape(width, -1)
        step = max(8, CELLS // len(query.hashes) // 8 * 8)
        for at in range(0, len(lengths), step):
            few = slice(at, min(at + step, len(lengths)))
            own = np.ascontiguousarray(matrix[:, at // 8 : (few.stop + 7) // 8]).tobytes()
            yield bounds(width, own, np.asarray(lengths)[few], query, levels), ids[few], prints[few]


def query_levels(query: Query) -> list[tuple[np.ndarray, np.ndarray]]:
    made = [level_hashes(query.hashes, n) for n in range(len(LEVELS))]
    return [(e, mix(e) | np.uint64(1)) for e in made]


def highest_bounds(index: DataFrame, query: Query, top: int) -> DataFrame:
    """(doc_id, row_hash) of the documents with the highest bounds for some item, ``top`` an item."""
    shared = index.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        levels = query_levels(q)
        n = len(q.items)
        best, who = np.zeros((n, top), np.int64), np.full((n, top), -1, np.int64)
        ids: list[pa.Array] = []
        prints: list[pa.Array] = []
        seen = 0
        for batch in batches:
            for found, doc_id, row in parts_of(batch, q, levels):
                better = np.flatnonzero(found.max(axis=1) > best.min(axis=1))
                both = np.concatenate([best[better], found[better]], axis=1)
                whom = np.concatenate([who[better], np.broadcast_to(seen + np.arange(found.shape[1]), (len(better), found.shape[1]))], axis=1)
                pick = np.argpartition(-both, top - 1, axis=1)[:, :top]
                best[better], who[better] = np.take_along_axis(both, pick, 1), np.take_along_axis(whom, pick, 1)
                ids.append(doc_id)
                prints.append(row)
                seen += len(doc_id)
        item, place = np.nonzero(best > 0)
        if len(item):
            doc = pa.array(who[item, place])
            yield pa.RecordBatch.from_pydict(
                {"item": q.items[item], "bound": best[item, place], "doc_id": pa.concat_arrays(ids).take(doc), "row_hash": pa.concat_arrays(prints).take(doc)}
            )

    rows = index.where("bits is not null").select("width", "bits", "doc_id", "row_hash", "length")
    found = rows.mapInArrow(run, "item long, bound long, doc_id long, row_hash long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "row_hash")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("doc_id", "row_hash")


def reaching(index: DataFrame, query: Query, floors: np.ndarray) -> DataFrame:
    """(doc_id, row_hash) of the documents whose bound reaches the floor of some item."""
    shared = index.sparkSession.sparkContext.broadcast((query, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = shared.value
        levels = query_levels(q)
        for batch in batches:
            for found, doc_id, row in parts_of(batch, q, levels):
                on = pa.array((found >= least[:, None]).any(axis=0))
                yield pa.RecordBatch.from_pydict({"doc_id": doc_id.filter(on), "row_hash": row.filter(on)})

    rows = index.where("bits is not null").select("width", "bits", "doc_id", "row_hash", "length")
    return rows.mapInArrow(run, "doc_id long, row_hash long")


def exact_scores(docs: DataFrame, wanted: DataFrame, query: Query, floors: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(item, doc_id, row_hash, score) of the wanted (doc_id, row_hash), from whole texts; scores below an item's floor are left out."""
    shared = docs.sparkSession.sparkContext.broadcast((query, floors))
    keys = materialise(wanted.distinct()).toDF("w_id", "w_hash")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_hash(F.col(text_col)).alias("row_hash"))
    joined = narrow.join(keys, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row_hash") == F.col("w_hash")), "left_semi")

    def run(part: pa.RecordBatch) -> Iterator[dict]:
        q, least = shared.value
        data, starts, ends, of = lowered(part.column("text"), ALNUM)
        on, term = q.find(data, starts, ends)
        doc, term, tf = distinct_pairs(of[on], term)
        m = q.length_parts(np.bincount(of, minlength=part.num_rows))
        value = q.weights[term] * share(tf, m[doc])
        step = max(1, CELLS // (len(q.refs) + len(q.hashes)))
        for first in range(0, part.num_rows, step):
            last = min(first + step, part.num_rows)
            own = (doc >= first) & (doc < last)
            every = np.zeros((len(q.hashes), last - first), np.int64)
            every[term[own], doc[own] - first] = value[own]
            scores = np.add.reduceat(every[q.refs], q.first[:-1], axis=0)
            item, row = np.nonzero(scores >= least[:, None])
            at = pa.array(first + row)
            yield {"item": q.items[item], "doc_id": part.column("doc_id").take(at), "row_hash": part.column("row_hash").take(at), "score": scores[item, row]}

    return arrow_map(joined.select("doc_id", "row_hash", "text"), run, "item long, doc_id long, row_hash long, score long", "text")


def best(scores: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row_hash")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_group(docs: DataFrame, rows: list[tuple[int, list[str]]], top: int, id_col: str, text_col: str) -> DataFrame:
    query = Query.of(rows)
    index = materialise(build_index(docs, query, id_col, text_col))
    counted = index.where("bits is not null").agg(F.sum(F.size("length")), F.sum(F.expr("aggregate(length, 0L, (a, x) -> a + x)"))).first()
    query.n_docs, query.n_terms = counted[0] or 0, counted[1] or 0
    df = np.zeros(len(query.hashes), np.int64)
    for term, n in index.where("bits is null").groupBy("term").agg(F.sum("n")).collect():  # a row a term of the group at most
        df[term] = n
    query.weights = np.array([weight(query.n_docs, n) for n in df.tolist()], np.int64)
    lowest = np.ones(len(query.items), np.int64)
    known = best(exact_scores(docs, highest_bounds(index, query, top), query, lowest, id_col, text_col), top)
    place = {item: n for n, item in enumerate(query.items.tolist())}
    floors = lowest.copy()
    for item, score in known.where(F.col("rank") == top).select("item", "score").collect():  # a row an item of the group at most
        floors[place[item]] = score
    return best(exact_scores(docs, reaching(index, query, floors), query, floors, id_col, text_col), top)


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    group_terms: int = ITEM_TERMS,
) -> DataFrame:
    """(item, item_id, rank, doc_id, row_hash, score): the best documents of every item."""
    asked = materialise(item_terms(items, item_col, item_text_col))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_groups = -(-total // group_terms)
    group = F.pmod(F.xxhash64("item"), F.lit(max(n_groups, 1)))
    found = []
    for n in range(n_groups):
        rows = [(r.item, list(r.terms)) for r in asked.where(group == n).select("item", "terms").orderBy("item").collect()]  # about group_terms terms
        if rows:
            found.append(search_group(docs, rows, top, id_col, text_col))
    if not found:
        none = asked.select("item", "item_id").where("false")
        return none.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("rank", "int"), ("doc_id", "long"), ("row_hash", "long"), ("score", "long"))])
    return reduce(DataFrame.unionByName, found).join(asked.select("item", "item_id"), "item")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    found = search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

OP11_SQL = f"""
WITH occurrences AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, {_TERM})) AS term FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, {_TERM})) AS term FROM benchmark
), lengths AS (
  SELECT doc_id, count(*) AS n FROM occurrences GROUP BY doc_id
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM occurrences WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, totals GROUP BY term
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
