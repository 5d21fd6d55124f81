"""Benchmark decontamination by winnowing.

Both sides are reduced to winnowed fingerprints: of every ``WINDOW - K + 1`` consecutive
K-word hashes the smallest is kept (the rightmost of equals).  Any shared run of WINDOW
words has the same K-word hashes on both sides, so it keeps the same fingerprint on both:
no shared run of that length is missed.  Fingerprints are joined, and each hit is extended
word by word to the longest shared run; runs of WINDOW words or more are contamination.
An item with fewer words is one window of its own length n, which is winnowing with
K = n and one hash a window.

Document fingerprints first pass a bitmap of the benchmark's fingerprints.  The bitmap has
a fixed size whatever the benchmark holds; it only saves rows, the join decides.

Nulls have no words: null documents are returned with zeros, null items match nothing.
Repeated rows of documents are judged each; repeated items keep their ids.  Items with
equal texts all count.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridlore.llm.common import (
    arrow_map,
    bitmap_of,
    in_bitmap,
    materialise,
    mix,
    ngram_hashes,
    read_table,
    row_hash,
    slices,
    span_hashes,
    text_bytes,
    word_spans,
)

WINDOW = 10
K = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, row of each word, words of each row)."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, ALNUM)
    return span_hashes(data, starts, ends), rows, np.bincount(rows, minlength=len(column))


def winnow(words: np.ndarray, rows: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the kept k-grams; no k-gram or window leaves its row."""
    grams = ngram_hashes(words, k)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    inside = rows[: len(grams)] == rows[k - 1 :]
    if window == 1:
        at = np.flatnonzero(inside)
        return at, grams[at]
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams[:0]
    least, where = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        next_ = grams[j : j + n]
        lower = next_ <= least
        least[lower] = next_[lower]
        where[lower] = j
    whole = rows[:n] == rows[k + window - 2 :]
    at = np.unique((np.arange(n) + where)[whole])
    return at, grams[at]


def class_shape(length_class: int, window: int, k: int) -> tuple[int, int]:
    """(words a hash, hashes a window) of items with that many words, ``window`` for longer ones."""
    return (k, window - k + 1) if length_class == window else (length_class, 1)


def tag(grams: np.ndarray, length_class: int) -> np.ndarray:
    """Keep the fingerprints of different length classes apart."""
    return mix(grams + np.uint64(length_class))


def contexts(words: np.ndarray, rows: np.ndarray, at: np.ndarray, size: int, reach: int, pad: int) -> np.ndarray:
    """A line for each position: the words from ``reach`` before to ``reach`` after the k-gram.

    Places outside the row hold ``pad``, which differs between the two sides and so never matches.
    """
    place = at[:, None] + np.arange(-reach, size + reach)[None, :]
    safe = np.clip(place, 0, max(len(words) - 1, 0))
    inside = (place >= 0) & (place < len(words)) & (rows[safe] == rows[at][:, None])
    return np.where(inside, words[safe], np.uint64(pad))


def binary_rows(lines: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(lines, dtype="<u8").tobytes()
    width = lines.shape[1] * 8
    offsets = np.arange(len(lines) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def item_fingerprints(items: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """(print, length_class, item_id, item_words): item_words as ``contexts`` gives them."""
    narrow = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        words, rows, counts = hashed_words(batch.column("text"))
        lengths = np.minimum(counts, window)
        for length_class in np.unique(lengths[lengths > 0]).tolist():
            size, span = class_shape(length_class, window, k)
            own = lengths[rows] == length_class
            w, r = words[own], rows[own]
            at, grams = winnow(w, r, size, span)
            if len(at):
                yield {
                    "print": tag(grams, length_class).view(np.int64),
                    "length_class": np.full(len(at), length_class, np.int32),
                    "item_id": batch.column("item_id").take(pa.array(r[at])),
                    "item_words": binary_rows(contexts(w, r, at, size, span - 1, 1)),
                }

    return arrow_map(narrow, run, "print long, length_class int, item_id string, item_words binary", "text").distinct()


def document_fingerprints(
    docs: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray, length_classes: list[int], window: int, k: int
) -> DataFrame:
    """(row_id, doc_id, row_hash, n_words, print, at, doc_words).

    Each document has one row with a null print, and one for each fingerprint in the bitmap.
    row_id tells rows with equal ids apart; it holds only within what this returns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_hash(F.col(text_col)).alias("row_hash"))
    schema = "row_id long, doc_id long, row_hash long, n_words long, print long, length_class int, at int, doc_words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                words, rows, counts = hashed_words(part.column("text"))
                n = part.num_rows
                ids = np.arange(next_id, next_id + n)
                next_id += n
                yield pa.RecordBatch.from_pydict(
                    {
                        "row_id": ids,
                        "doc_id": part.column("doc_id"),
                        "row_hash": part.column("row_hash"),
                        "n_words": counts.astype(np.int64),
                        "print": pa.nulls(n, pa.int64()),
                        "length_class": pa.nulls(n, pa.int32()),
                        "at": pa.nulls(n, pa.int32()),
                        "doc_words": pa.nulls(n, pa.binary()),
                    }
                )
                first = np.cumsum(counts) - counts
                for length_class in length_classes:
                    size, span = class_shape(length_class, window, k)
                    at, grams = winnow(words, rows, size, span)
                    prints = tag(grams, length_class)
                    on = in_bitmap(shared.value, prints)
                    at, prints = at[on], prints[on]
                    if len(at):
                        owner = rows[at]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "row_id": ids[owner],
                                "doc_id": pa.nulls(len(at), pa.int64()),
                                "row_hash": pa.nulls(len(at), pa.int64()),
                                "n_words": pa.nulls(len(at), pa.int64()),
                                "print": prints.view(np.int64),
                                "length_class": np.full(len(at), length_class, np.int32),
                                "at": (at - first[owner]).astype(np.int32),
                                "doc_words": binary_rows(contexts(words, rows, at, size, span - 1, 0)),
                            }
                        )

    return narrow.mapInArrow(run, schema)


def extend(joined: DataFrame, window: int, k: int) -> DataFrame:
    """(row_id, item_id, start, stop): shared runs of a whole window or more around each hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = np.asarray(batch.column("length_class"))
            for length_class in np.unique(classes).tolist():
                part = batch.filter(pa.array(classes == length_class))
                size, span = class_shape(length_class, window, k)
                width = size + 2 * (span - 1)
                mine, theirs = (
                    np.frombuffer(b"".join(part.column(c).to_pylist()), "<u8").reshape(-1, width)
                    for c in ("doc_words", "item_words")
                )
                same = mine == theirs
                core = same[:, span - 1 : span - 1 + size].all(axis=1)
                left = np.cumprod(same[:, : span - 1][:, ::-1], axis=1).sum(axis=1)
                right = np.cumprod(same[:, span - 1 + size :], axis=1).sum(axis=1)
                hit = core & (left + size + right >= length_class)
                at = np.asarray(part.column("at"))
                yield pa.RecordBatch.from_pydict(
                    {
                        "row_id": part.column("row_id").filter(pa.array(hit)),
                        "item_id": part.column("item_id").filter(pa.array(hit)),
                        "start": (at - left)[hit].astype(np.int32),
                        "stop": (at + size + right)[hit].astype(np.int32),
                    }
                )

    columns = joined.select("row_id", "item_id", "length_class", "at", "doc_words", "item_words")
    return columns.mapInArrow(run, "row_id long, item_id string, start int, stop int")


def covered(spans: DataFrame) -> DataFrame:
    """(row_id, n_hit): words in the union of each row's spans."""
    by_start = Window.partitionBy("row_id").orderBy("start", "stop")
    reached = F.coalesce(F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        spans.select("row_id", "start", "stop")
        .distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reached)))
        .groupBy("row_id")
        .agg(F.sum("new").cast("long").alias("n_hit"))
    )


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, row_hash, n_words, n_hit, item_ids, contaminated) of each row of documents."""
    if not 1 <= k <= window:
        raise ValueError("k must be between 1 and the window")
    prints = materialise(item_fingerprints(benchmark, item_col, item_text_col, window, k))
    bitmap = bitmap_of(prints, "print")
    length_classes = sorted(r[0] for r in prints.select("length_class").distinct().collect())  # at most window values
    rows = materialise(document_fingerprints(documents, id_col, text_col, bitmap, length_classes, window, k))
    joined = rows.where("print is not null").join(prints.drop("length_class"), "print")
    spans = materialise(extend(joined, window, k))
    items = spans.groupBy("row_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return (
        rows.where("print is null")
        .select("row_id", "doc_id", "row_hash", "n_words")
        .join(covered(spans).join(items, "row_id"), "row_id", "left")
        .select(
            "doc_id",
            "row_hash",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside benchmark windows; one row a document."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )
