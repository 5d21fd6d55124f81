"""Shared helpers: shared-folder materialisation, and byte-level views of Arrow string columns.

Operators run numpy inside Arrow batches.  Batches are cut into small slices first, so
the working set of a task does not depend on the batch size that Spark chose; a single
text is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlore.sources.shared import materialise, shared_dir, shared_path  # noqa: F401  for the operators

SLICE_BYTES = 1 << 20


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Within this, a query's shuffle files go when it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch of about ``limit`` text bytes, one row at least."""
    if not batch.num_rows:
        return
    lengths = np.diff(offsets_of(batch.column(column)))
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=width)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, end to end, and the row offsets.  A null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = offsets_of(column)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def arrow_map(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], Iterable[dict] | dict | pa.RecordBatch],
    schema: str,
    column: str,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``function`` to byte-bounded slices of every batch; it returns columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield from as_batches(function(part))

    return df.mapInArrow(run, schema)


def as_batches(made) -> Iterator[pa.RecordBatch]:
    if isinstance(made, pa.RecordBatch):
        yield made
    elif isinstance(made, dict):
        yield pa.RecordBatch.from_pydict(made)
    elif made is not None:
        for each in made:
            yield from as_batches(each)


MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each row, and the row of each run."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[:-1] = inside
    before = np.zeros(len(data) + 1, np.int8)
    before[1:] = inside
    starts_at = np.zeros(len(data) + 1, bool)
    starts_at[offsets] = True
    opens = np.flatnonzero((edge == 1) & ((before == 0) | starts_at))
    closes = np.flatnonzero((before == 1) & ((edge == 0) | starts_at))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(opens, offsets)))
    return opens, closes, rows


LANE_MASKS = np.array([(1 << (8 * n)) - 1 if n < 8 else (1 << 64) - 1 for n in range(9)], np.uint64)


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(padded) - 7, 8), (1, 1))


def lane_words(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next bytes of each span, ``left`` of them and eight at most, as an integer."""
    return np.ascontiguousarray(lanes[at]).view(np.uint64).ravel() & LANE_MASKS[np.minimum(left, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: equal spans have equal hashes wherever they stand.

    Each span is read in lanes of eight bytes, so the work is a few passes over the spans.
    """
    lengths = ends - starts
    lanes = lanes_of(data)
    out = mix(lengths.astype(np.uint64) + np.uint64(int(BASE) * (2 * seed + 1) & (1 << 64) - 1))
    todo = np.arange(len(starts))
    at = starts.astype(np.int64)
    left = lengths.astype(np.int64)
    while len(todo):
        word = lane_words(lanes, at, left)
        out[todo] = mix((out[todo] * BASE) ^ word)
        keep = left > 8
        todo, at, left = todo[keep], at[keep] + 8, left[keep] - 8
    return out


def same_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether each span of a has the very bytes of its partner in b."""
    out = (a_ends - a_starts) == (b_ends - b_starts)
    todo = np.flatnonzero(out)
    a_lanes, b_lanes = lanes_of(a), lanes_of(b)
    a_at, b_at, left = a_starts[todo].astype(np.int64), b_starts[todo].astype(np.int64), (a_ends - a_starts)[todo].astype(np.int64)
    while len(todo):
        same = lane_words(a_lanes, a_at, left) == lane_words(b_lanes, b_at, left)
        out[todo[~same]] = False
        keep = same & (left > 8)
        todo, a_at, b_at, left = todo[keep], a_at[keep] + 8, b_at[keep] + 8, left[keep] - 8
    return out


def span_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    chosen = data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(chosen.tobytes())]).cast(pa.string())


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (runs across rows included)."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * BASE + words[k : k + count]
    return mix(out)


def row_hash(text: Column) -> Column:
    """Tells rows with equal ids apart when a verdict is joined back; rows with equal texts are one document."""
    return F.xxhash64(text.cast("string"))


def rows_in(df: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of df whose (id, row_hash) is in ``chosen``, a frame of doc_id and row_hash."""
    keys = chosen.select(F.col("doc_id").alias("_chosen_id"), F.col("row_hash").alias("_chosen_hash"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_chosen_id")) & (row_hash(F.col(text_col)) == F.col("_chosen_hash"))
    return df.join(keys, same, "left_semi")


OFTEN = 1024


def join_by_count(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``table`` that belong to their key.

    The table has one row for each key of the rows, and ``n`` counts the rows with it.  Keys
    with over 1/OFTEN of all rows, which are fewer than OFTEN, are broadcast, so that none of
    them meets in one task; the others are shuffled.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(table.where(F.col("n") * OFTEN > total).drop("n"))
    others = rows.join(often.select(key), key, "left_anti")
    return rows.join(often, key).unionByName(others.join(table.where(F.col("n") * OFTEN <= total).drop("n"), key))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BITMAP_BITS = 24


def bitmap_of(df: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap over the leading bits of a long column of hashes.

    Its size is fixed, 2 MB by default, whatever df holds; the driver gets at most one row
    for each 64-bit word of it.  It tells what cannot be in df; a join has to decide the rest.
    """
    words = (
        df.select(F.expr(f"shiftrightunsigned({column}, {64 - bits})").alias("slot"))
        .groupBy(F.expr("shiftright(slot, 6)").alias("word"))
        .agg(F.expr("bit_or(1L << CAST(slot & 63 AS INT))").alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
    return bitmap


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    slot = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
