"""Source divergence audit: how sources of a language differ in their use of terms.

Two passes over the texts.  The first counts the documents of each (language, term) exactly; terms of
``least_docs`` documents or more are kept.  Kept terms are dealt by hash into shards of about
SHARD_TERMS, and each shard gets a minimal perfect hash: keys fall into buckets, and every bucket has a
pilot that sends its keys to free slots.  A slot stores its key.

The second pass looks every word up: shard, bucket, pilot, slot, and then the stored key, byte by byte, so that
no other word is counted.  It increments dense counters, one array a group with a place for each slot of the
language; groups that no longer fit SLOT_BYTES hand their sums on slice by slice.  What a task found is merged in sorted
streams, one array of a shard at a time.  Shards are broadcast in waves of about WAVE_BYTES; each wave is a pass over the texts, so
what is broadcast does not grow with the vocabulary.

With p = 1 + floor(SCALE * (count + 2) / (N + 2 V)) for each group and kept term, f = floor((p - q)^2 / (p + q)) compares groups
(part ``pair``: each other source of the language, summed over the kept terms) and a group with its language (part ``term``).
Sources are compared in blocks of SOURCES, a shard at a time, so that no task holds all sources or all terms.

Null texts have no terms, null languages and sources are ''.  Groups without terms take part; a language without kept
terms has pairs of value 0.  Repeated rows count each; ids are not read.  An empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridlore.llm.common import BASE, arrow_map, join_by_count, materialise, mix, read_table, same_spans, slices, span_hashes, span_strings, text_bytes, word_spans
from gridlore.llm.decontaminate import LOWER

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
SHARD_TERMS = 2048
#: Keys a bucket, about.
BUCKET = 4
WAVE_BYTES = 64 << 20
SLOT_BYTES = 96 << 20
#: Sources of a block.
SOURCES = 256
PASS_SLICE = 2 << 20

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, starts, ends, rows) of the terms of a column."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    return data, *word_spans(data, offsets, LETTERS)


def numbered(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each row's value, the values)."""
    coded = pc.dictionary_encode(column)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def exact_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a code for each span, their order): spans have equal codes if and only if their bytes are equal."""
    codes = span_hashes(data, starts, ends)
    order = np.argsort(codes, kind="stable")
    a, b = order[:-1], order[1:]
    twins = codes[a] == codes[b]
    a, b = a[twins], b[twins]
    if not same_spans(data, starts[a], ends[a], data, starts[b], ends[b]).all():  # two words, one hash
        raw = np.array([data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], object)
        codes = np.unique(raw, return_inverse=True)[1].astype(np.uint64)
        order = np.argsort(codes, kind="stable")
    return codes, order


def named(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(blank(text_col).alias("text"), blank(lang_col).alias("lang"), blank(source_col).alias("source"))


def kept_terms(texts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, n_docs) of the terms in at least ``least_docs`` documents of their language."""

    def run(part: pa.RecordBatch) -> Iterator[dict]:
        data, starts, ends, rows = terms_in(part.column("text"))
        if not len(rows):
            return
        codes, order = exact_codes(data, starts, ends)
        codes, rows = codes[order], rows[order]
        new = np.ones(len(order), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])  # once a document
        order, codes = order[new], codes[new]
        lang, langs = numbered(part.column("lang"))
        lang = lang[rows[new]]
        for n in np.unique(lang).tolist():
            own = order[lang == n]
            first = np.flatnonzero(np.append(True, codes[lang == n][1:] != codes[lang == n][:-1]))
            at = own[first]
            yield {
                "lang": pa.repeat(langs[n], len(at)),
                "term": span_strings(data, starts[at], ends[at]),
                "n": np.diff(np.append(first, len(own))).astype(np.int64),
            }

    counted = arrow_map(texts.select("lang", "text"), run, "lang string, term string, n long", "text", PASS_SLICE)
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= least_docs)


def key_parts(hashes: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The bucket of each key, of max(1, size // BUCKET)."""
    return (mix(hashes) % np.maximum(np.asarray(size, np.uint64) // np.uint64(BUCKET), np.uint64(1))).astype(np.int64)


def slot_of(hashes: np.ndarray, pilots: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return (mix(hashes + mix(pilots.astype(np.uint64) + BASE)) % np.asarray(size, np.uint64)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilot of each bucket, slot of each key): the slots are 0 .. n-1, each once.  Hashes differ."""
    n = len(hashes)
    bucket = key_parts(hashes, n)
    sizes = np.bincount(bucket, minlength=max(1, n // BUCKET))
    order = np.argsort(bucket, kind="stable")
    first = np.concatenate([[0], np.cumsum(sizes)])
    pilots, slots = np.zeros(len(sizes), np.uint32), np.zeros(n, np.int64)
    taken = np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable").tolist():
        keys = order[first[b] : first[b + 1]]
        if not len(keys):
            break
        start, tries = 0, 16
        while True:
            pilot = np.arange(start, start + tries)
            at = slot_of(hashes[keys][:, None], pilot[None, :], n)
            good = ~taken[at].any(axis=0)
            if len(keys) > 1:
                ranked = np.sort(at, axis=0)
                good &= (ranked[1:] != ranked[:-1]).all(axis=0)
            if good.any():
                hit = int(np.argmax(good))
                pilots[b], slots[keys] = pilot[hit], at[:, hit]
                taken[at[:, hit]] = True
                break
            start, tries = start + tries, min(4096, tries * 4)
    return pilots, slots


SHARD = "lang string, shard int, size int, seed int, pilots binary, key_ends binary, keys binary"


def shards_of(kept: DataFrame, shard_terms: int) -> DataFrame:
    """A row for each shard: its pilots, and the stored keys in the order of their slots."""
    langs = kept.groupBy("lang").agg(F.count("*").alias("n")).withColumn("n_shards", F.ceil(F.col("n") / shard_terms).cast("int"))

    def deal(part: pa.RecordBatch) -> dict:
        data, offsets = text_bytes(part.column("term"))
        shard = span_hashes(data, offsets[:-1], offsets[1:]) % np.asarray(part.column("n_shards")).astype(np.uint64)
        return {"lang": part.column("lang"), "term": part.column("term"), "shard": shard.astype(np.int32)}

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        data, offsets = text_bytes(group.column("term").chunk(0))
        seed = 0
        while len(np.unique(hashes := span_hashes(data, offsets[:-1], offsets[1:], seed))) < len(hashes):
            seed += 1
        pilots, slots = perfect_hash(hashes)
        order = np.argsort(slots)
        ends = np.cumsum(np.diff(offsets)[order]).astype("<i4")
        keys = group.column("term").chunk(0).take(pa.array(order)).cast(pa.binary()).to_pylist()
        row = (group.column("lang")[0].as_py(), group.column("shard")[0].as_py(), len(hashes), seed, pilots.astype("<u4").tobytes(), ends.tobytes(), b"".join(keys))
        names = [c.split()[0] for c in SHARD.split(", ")]
        return pa.table({c: pa.array([v], pa.int32() if c in ("shard", "size", "seed") else None) for c, v in zip(names, row, strict=True)})

    dealt = arrow_map(join_by_count(kept.select("lang", "term"), langs, "lang"), deal, "lang string, term string, shard int", "term")
    return dealt.groupBy("lang", "shard").applyInArrow(build, SHARD)


@dataclass
class Wave:
    """Shards that a task looks words up in, language after language."""

    #: For each language where its shards begin in ``local``, how many it has, where its slots begin and how many are here.
    langs: dict[str, tuple[int, int, int, int]]
    #: The place here of each shard of each language, or -1.
    local: np.ndarray
    shard: np.ndarray
    size: np.ndarray
    seed: np.ndarray
    first_slot: np.ndarray
    first_pilot: np.ndarray
    pilots: np.ndarray
    key_starts: np.ndarray
    key_ends: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(table: pa.Table, n_shards: dict[str, int]) -> Wave:
        table = table.sort_by([("lang", "ascending"), ("shard", "ascending")])
        names, shard = table.column("lang").to_pylist(), np.asarray(table.column("shard")).astype(np.int64)
        size = np.asarray(table.column("size")).astype(np.int64)
        langs, local, at = {}, [], 0
        upto = np.concatenate([[0], np.cumsum(size)])
        for lang in dict.fromkeys(names):
            own = np.array([k for k, n in enumerate(names) if n == lang])
            here = np.full(n_shards[lang], -1, np.int64)
            here[shard[own]] = own
            langs[lang] = (at, n_shards[lang], int(upto[own[0]]), int(size[own].sum()))
            local.append(here)
            at += n_shards[lang]
        raw = [k for k in table.column("keys").to_pylist()]
        before = np.concatenate([[0], np.cumsum([len(k) for k in raw])])[:-1]
        ends = [np.frombuffer(e, "<i4").astype(np.int64) for e in table.column("key_ends").to_pylist()]
        pilots = [np.frombuffer(p, "<u4") for p in table.column("pilots").to_pylist()]
        return Wave(
            langs,
            np.concatenate(local),
            shard,
            size,
            np.asarray(table.column("seed")).astype(np.int64),
            upto[:-1],
            np.concatenate([[0], np.cumsum([len(p) for p in pilots])])[:-1],
            np.concatenate(pilots),
            np.concatenate([np.append(0, e[:-1]) + b for e, b in zip(ends, before, strict=True)]),
            np.concatenate([e + b for e, b in zip(ends, before, strict=True)]),
            np.frombuffer(b"".join(raw), np.uint8),
        )

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n_shards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words that are kept terms, the slot of each); n_shards is 0 for words of a language that is not here."""
        on = np.flatnonzero(n_shards > 0)
        hashes = span_hashes(data, starts[on], ends[on])
        place = self.local[first[on] + (hashes % n_shards[on].astype(np.uint64)).astype(np.int64)]
        on, hashes, place = on[place >= 0], hashes[place >= 0], place[place >= 0]
        for seed in np.unique(self.seed[place]).tolist():
            if seed:
                some = np.flatnonzero(self.seed[place] == seed)
                hashes[some] = span_hashes(data, starts[on[some]], ends[on[some]], seed)
        pilots = self.pilots[self.first_pilot[place] + key_parts(hashes, self.size[place])]
        slot = self.first_slot[place] + slot_of(hashes, pilots, self.size[place])
        same = same_spans(data, starts[on], ends[on], self.keys, self.key_starts[slot], self.key_ends[slot])
        return on[same], slot[same]


COUNTS = "lang string, source string, shard int, slots binary, counts binary"


def counted(texts: DataFrame, wave: Wave, slot_bytes: int) -> DataFrame:
    """Sums of each task, a row for each group and shard: slots that occur and how often."""
    shared = texts.sparkSession.sparkContext.broadcast(wave)

    def packed(w: Wave, lang: str, source: str, slot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        place = np.searchsorted(w.first_slot, slot, side="right") - 1
        cuts = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(slot))
        own = place[cuts[:-1]]
        inside = (slot - w.first_slot[place]).astype("<i4")
        cut = lambda a: pa.array([a[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_pydict(
            {"lang": pa.repeat(lang, len(own)), "source": pa.repeat(source, len(own)), "shard": w.shard[own].astype(np.int32), "slots": cut(inside), "counts": cut(n.astype("<i8"))}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        dense: dict[tuple[str, str], np.ndarray] = {}
        room = slot_bytes
        for batch in batches:
            for part in slices(batch, "text", PASS_SLICE):
                lang, langs = numbered(part.column("lang"))
                source, sources = numbered(part.column("source"))
                group = lang * len(sources) + source
                data, starts, ends, rows = terms_in(part.column("text"))
                place = np.array([w.langs.get(n, (0, 0, 0, 0)) for n in langs.to_pylist()], np.int64).reshape(-1, 4)
                of = lang[rows]
                on, slot = w.find(data, starts, ends, place[of, 0], place[of, 1])
                width = len(w.key_ends)
                key, n = np.unique(group[rows[on]] * width + slot, return_counts=True)
                owner, slot = key // width, key % width
                cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(key)) if len(key) else [0]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    name = langs[int(owner[x]) // len(sources)].as_py(), sources[int(owner[x]) % len(sources)].as_py()
                    _, _, first, size = w.langs[name[0]]
                    if name not in dense and room >= 8 * size:
                        dense[name] = np.zeros(size, np.int64)
                        room -= 8 * size
                    if name in dense:
                        dense[name][slot[x:y] - first] += n[x:y]
                    else:
                        yield packed(w, *name, slot[x:y], n[x:y])
        for name, sums in dense.items():
            on = np.flatnonzero(sums)
            yield packed(w, *name, on + w.langs[name[0]][2], sums[on])

    return texts.mapInArrow(run, COUNTS)


def merged(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., slots, counts, total): rows with equal keys added up, one array of a shard at a time."""
    schema = ", ".join(f"{c} {'int' if c == 'shard' else 'string'}" for c in by) + ", slots binary, counts binary, total long"
    kinds = [pa.int32() if c == "shard" else pa.string() for c in by]

    def made(key: tuple, sums: np.ndarray) -> pa.RecordBatch:
        on = np.flatnonzero(sums)
        given = [pa.array([v], k) for v, k in zip(key, kinds, strict=True)]
        rest = [pa.array([on.astype("<i4").tobytes()]), pa.array([sums[on].astype("<i8").tobytes()]), pa.array([int(sums.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(given + rest, [*by, "slots", "counts", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, np.zeros(0, np.int64)
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in by], strict=True)
            for key, slot, n in zip(keys, batch.column("slots"), batch.column("counts"), strict=True):
                if key != held:
                    if held is not None:
                        yield made(held, sums)
                    held, sums = key, np.zeros(0, np.int64)
                at = np.frombuffer(slot.as_py(), "<i4")
                if len(at) and at.max() >= len(sums):
                    sums = np.append(sums, np.zeros(at.max() + 1 - len(sums), np.int64))
                sums[at] += np.frombuffer(n.as_py(), "<i8")
        if held is not None:
            yield made(held, sums)

    return counts.select(*by, "slots", "counts").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def scaled(counts: np.ndarray, total: np.ndarray | int, n_terms: np.ndarray | int) -> np.ndarray:
    """p of each count, exact: a long division, as the product may not fit 64 bits."""
    whole = np.asarray(total, np.int64) + 2 * np.asarray(n_terms, np.int64)
    left, out = np.asarray(counts, np.int64) + 2, 0
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return 1 + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_values(groups: DataFrame, counts: DataFrame, shards: DataFrame, sources: int) -> DataFrame:
    """(lang, source, item, value): f of each two sources of a language, summed over its kept terms; both directions."""
    blocks = groups.groupBy("lang").agg(F.count("*").alias("n")).withColumn("n_blocks", F.ceil(F.col("n") / sources).cast("int"))
    own = join_by_count(groups, blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int"))
    spread = own.withColumn("shard", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_shards"), F.lit(1)) - 1)))
    rows = spread.join(counts.select("lang", "source", "shard", "slots", "counts"), ["lang", "source", "shard"], "left").join(
        shards.select("lang", "shard", "size"), ["lang", "shard"], "left"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    dealt = rows.select("*", other).select(
        "lang", "shard", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "source", "n_total", "n_terms", "size", "slots", "counts"
    )

    def compare(group: pa.Table) -> pa.Table:
        names, block = group.column("source").to_pylist(), np.asarray(group.column("block").combine_chunks())
        size = group.column("size")[0].as_py() or 0
        table = np.zeros((len(names), size), np.int64)
        for k, (slot, n) in enumerate(zip(group.column("slots").to_pylist(), group.column("counts").to_pylist(), strict=True)):
            if slot:
                table[k, np.frombuffer(slot, "<i4")] = np.frombuffer(n, "<i8")
        if size:
            table = scaled(table, np.asarray(group.column("n_total").combine_chunks())[:, None], group.column("n_terms")[0].as_py())
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        a, b, value = [], [], []
        for k in range(len(names)):
            those = np.arange(k + 1, len(names)) if low == high else np.flatnonzero(block == high) if block[k] == low else []
            if len(those):
                a += [names[k]] * len(those)
                b += [names[j] for j in those]
                value.append(apart(table[k], table[those]).sum(axis=1))
        lang = pa.repeat(group.column("lang")[0], len(a)).cast(pa.string())
        return pa.table({"lang": lang, "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": np.concatenate(value) if value else np.zeros(0, np.int64)})

    found = dealt.groupBy("lang", "shard", "low", "high").applyInArrow(compare, "lang string, a string, b string, value long")
    # rows of a group come in any order, so shards may name a pair either way round
    summed = found.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    return summed.select("lang", "value", ways).select("lang", "w.source", "w.item", "value")


def term_values(groups: DataFrame, counts: DataFrame, shards: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): terms that a group uses more than its language, the best of each shard."""
    of_lang = merged(counts, ("lang", "shard")).select("lang", "shard", F.col("slots").alias("all_slots"), F.col("counts").alias("all_counts"))
    whole = of_lang.join(shards.select("lang", "shard", "size", "key_ends", "keys"), ["lang", "shard"])
    totals = groups.select("lang", "source", "n_total", "n_terms", "lang_total")
    rows = counts.select("lang", "source", "shard", "slots", "counts").join(totals, ["lang", "source"]).join(whole, ["lang", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                everywhere = np.zeros(r["size"], np.int64)
                everywhere[np.frombuffer(r["all_slots"], "<i4")] = np.frombuffer(r["all_counts"], "<i8")
                slot, n = np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["counts"], "<i8")
                p, q = scaled(n, r["n_total"], r["n_terms"]), scaled(everywhere[slot], r["lang_total"], r["n_terms"])
                slot, value = slot[p > q], apart(p, q)[p > q]
                if len(value) > top:  # ties at the last place stay until the final ranking
                    on = value >= np.partition(value, -top)[-top]
                    slot, value = slot[on], value[on]
                if len(value):
                    ends = np.frombuffer(r["key_ends"], "<i4").astype(np.int64)
                    starts = np.append(0, ends[:-1])
                    keys = np.frombuffer(r["keys"], np.uint8)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": pa.repeat(r["lang"], len(slot)),
                            "source": pa.repeat(r["source"], len(slot)),
                            "item": span_strings(keys, starts[slot], ends[slot]),
                            "value": value,
                        }
                    )

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def divergence(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    shard_terms: int = SHARD_TERMS,
    wave_bytes: int = WAVE_BYTES,
    slot_bytes: int = SLOT_BYTES,
    sources: int = SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group."""
    spark = docs.sparkSession
    texts = named(docs, text_col, lang_col, source_col)
    shards = materialise(shards_of(materialise(kept_terms(texts, least_docs)), shard_terms))
    sizes = shards.groupBy("lang").agg(
        F.ceil(F.sum("size") / shard_terms).cast("int").alias("n_shards"),  # as shards_of deals, empty ones too
        F.sum("size").cast("long").alias("n_terms"),
        F.sum(F.length("keys") + F.length("key_ends") + F.length("pilots")).alias("n_bytes"),
    )
    langs = sizes.collect()  # a row a language with kept terms
    n_shards = {r.lang: r.n_shards for r in langs}
    n_waves = -(-sum(r.n_bytes for r in langs) // wave_bytes)
    wave = F.pmod(F.xxhash64("lang", "shard"), F.lit(max(n_waves, 1)))
    partials = spark.createDataFrame([], COUNTS)
    for n in range(n_waves):
        table = shards.where(wave == n).toArrow()  # about wave_bytes
        if table.num_rows:
            partials = partials.unionByName(counted(texts, Wave.of(table, n_shards), slot_bytes))
    counts = materialise(merged(partials, ("lang", "source", "shard")))
    found = texts.select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("n_total"))
    of_lang = counts.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    zero = lambda c, k: F.coalesce(F.col(c), F.lit(0)).cast(k).alias(c)
    groups = materialise(
        found.join(totals, ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", zero("n_total", "long"), zero("lang_total", "long"), zero("n_terms", "long"), zero("n_shards", "int"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    pairs = ranked(pair_values(groups, counts, shards, sources), "pair")
    return pairs.unionByName(ranked(term_values(groups, counts, shards, top), "term").where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ; see divergence."""
    return divergence(read_table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents
), occurrences AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}
), vocabulary AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), found AS (
  SELECT lang, source, term, count(*) AS n FROM occurrences JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
  SELECT lang, source, sum(n) AS total FROM found GROUP BY lang, source
), groups AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN vocabulary USING (lang)
), shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + ({SCALE} * CAST(coalesce(n, 0) + 2 AS HUGEINT)) // (total + 2 * v) AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)
), whole AS (
  SELECT lang, term, 1 + ({SCALE} * CAST(sum(n) + 2 AS HUGEINT)) // (any_value(t.total) + 2 * any_value(t.v)) AS q
  FROM found JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM groups GROUP BY lang) t USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
