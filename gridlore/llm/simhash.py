"""SimHash near-duplicates by deletion-variant signatures.

Every text gets a 64-bit fingerprint of its word shingles.  Fingerprints link when they
differ in at most three bits.  Cut into two halves, one half of a linked pair differs in at
most one bit, so both share a variant of that half in which one bit is wild.  The 64
variants of each distinct fingerprint are dealt by an equality key, buckets are verified
against the bit distance, and only a spanning forest of each bucket's links is kept: what
is linked stays linked, without all pairs of a bucket.

A bucket with more than ``BUCKET_ROWS`` fingerprints is dealt again by variants of the
other half (cut into two quarters, one of which differs in at most one bit), which fixes
46 of 64 bits and so bounds what one key can hold.

Null texts and texts without words have fingerprint zero and are linked like any other.
Rows with a null id take part, but never name a component unless all its ids are null.
Repeated ids are fingerprinted each.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.llm.common import arrow_map, join_by_count, materialise, read_table, row_hash, text_bytes, word_spans
from gridlore.llm.graph import connected_components

MAX_BITS = 3
SEED = 42
BUCKET_ROWS = 4096

#: Fixed values of the XXH64 algorithm.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False


def rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 with seed 42 of byte spans; spans under 32 bytes are hashed together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    h = np.full(len(starts), SEED, np.uint64) + P5 + lengths.astype(np.uint64)
    at = starts.copy()
    for k in range(3):
        on = np.flatnonzero(lengths >= 8 * (k + 1))
        lane = lanes[at[on]].view(np.uint64).ravel()
        h[on] = rotate(h[on] ^ (rotate(lane * P2, 31) * P1), 27) * P1 + P4
        at[on] += 8
    on = np.flatnonzero(lengths & 4)
    lane = lanes[at[on]].view(np.uint64).ravel() & np.uint64(0xFFFFFFFF)
    h[on] = rotate(h[on] ^ (lane * P1), 23) * P2 + P3
    at[on] += 4
    for k in range(3):
        on = np.flatnonzero((lengths & 3) > k)
        h[on] = rotate(h[on] ^ (padded[at[on]].astype(np.uint64) * P5), 11) * P1
        at[on] += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(lengths >= 32):
        s = starts[i]
        h[i] = xxhash.xxh64_intdigest(data[s : s + lengths[i]].tobytes(), SEED)
    return h


def majority(h: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the word of the bits that over half of them have.

    Eight bit planes are added up as byte counters, at most 255 hashes at a time.
    """
    out = np.zeros(len(first), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = first[full][owner] + 255 * nth
    ones = np.uint64(0x0101010101010101)
    piece_start = np.cumsum(pieces) - pieces
    fingerprint = np.zeros(len(full), np.uint64)
    for plane in range(8):
        sums = np.add.reduceat((h >> np.uint64(plane)) & ones, cuts)
        by_byte = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        set_bits = np.add.reduceat(by_byte, piece_start, axis=0)
        for byte in range(8):
            over = (2 * set_bits[:, byte] > counts[full]).astype(np.uint64)
            fingerprint |= over << np.uint64(8 * byte + plane)
    out[full] = fingerprint
    return out


def fingerprints_of(column: pa.Array, shingle: int = 3) -> np.ndarray:
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, VISIBLE)
    lengths = ends - starts
    # the words of the slice again, each with one space after it
    out_starts = np.cumsum(lengths + 1) - (lengths + 1)
    spaced = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    move = np.repeat(out_starts - starts, lengths)
    source = np.flatnonzero(VISIBLE[data])
    spaced[source + move] = data[source]
    out_ends = out_starts + lengths
    n_words = np.bincount(rows, minlength=len(column))
    first_word = np.cumsum(n_words) - n_words
    counts = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    owner = np.repeat(np.arange(len(column)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = first_word[owner] + nth
    tail = head + np.minimum(n_words[owner], shingle) - 1
    h = xxh64_spans(spaced, out_starts[head], out_ends[tail] - out_starts[head])
    return majority(h, np.cumsum(counts) - counts, counts)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_hash, fp): fp holds the 64 bits as a long."""
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_hash(F.col(text_col)).alias("row_hash"))

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in ("doc_id", "row_hash")} | {"fp": fingerprints_of(batch.column("text")).view(np.int64)}

    return arrow_map(narrow, run, "doc_id long, row_hash long, fp long", "text")


def variants(nodes: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard variants of both halves."""
    return (
        nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
        .withColumn("half", F.expr("CASE WHEN v < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"))
        .select(F.expr("(CAST(v AS BIGINT) << 32) | (half & ~(1L << (v % 32)))").alias("key"), "fp")
    )


def quarter_variants(hot: DataFrame) -> DataFrame:
    """Deal the rows of large buckets again by the half that their key leaves free."""
    return (
        hot.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(31))))
        .withColumn("free", F.expr("CASE WHEN (key >> 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"))
        .withColumn("quarter", F.expr("CASE WHEN w < 16 THEN free & 65535L ELSE shiftrightunsigned(free, 16) END"))
        .select(F.expr("xxhash64(key, w, quarter & ~(1L << (w % 16)))").alias("key"), "fp")
    )


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one bucket."""
    left, right = [], []
    rest = np.unique(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= MAX_BITS
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def link_buckets(keyed: DataFrame, most: int | None) -> DataFrame:
    """(hot, a, b): links a-b of each bucket, or the rows key-fp of buckets over ``most`` rows."""
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")

    def emit(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets, sorted by key."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(cuts)
        left, right, hot_key, hot_fp = [], [], [], []
        two = cuts[:-1][sizes == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= MAX_BITS
        left.append(a[near])
        right.append(b[near])
        for k in np.flatnonzero(sizes > 2):
            run = slice(cuts[k], cuts[k + 1])
            if most and sizes[k] > most:
                hot_key.append(key[run])
                hot_fp.append(fp[run])
            else:
                x, y = forest(fp[run])
                left.append(x)
                right.append(y)
        yield batch_of(False, np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))
        if hot_key:
            yield batch_of(True, np.concatenate(hot_key), np.concatenate(hot_fp).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp, passing = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            key = np.concatenate([held_key, np.asarray(batch.column("key"))])
            fp = np.concatenate([held_fp, np.asarray(batch.column("fp")).view(np.uint64)])
            if passing is not None:
                n = int(np.searchsorted(key, passing, side="right"))
                if n:
                    yield batch_of(True, key[:n], fp[:n].view(np.int64))
                    key, fp = key[n:], fp[n:]
            if not len(key):
                held_key, held_fp = key, fp
                continue
            last = int(np.searchsorted(key, key[-1], side="left"))
            if last:
                yield from emit(key[:last], fp[:last])
            held_key, held_fp = key[last:], fp[last:]
            if most and len(held_key) > most:
                passing = held_key[0]
                yield batch_of(True, held_key, held_fp.view(np.int64))
                held_key, held_fp = held_key[:0], held_fp[:0]
        if len(held_key):
            yield from emit(held_key, held_fp)

    return dealt.mapInArrow(run, "hot boolean, a long, b long")


def batch_of(hot: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"hot": np.full(len(a), hot), "a": a, "b": b})


def links(nodes: DataFrame, most: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links whose components are those of all pairs within three bits."""
    first = materialise(link_buckets(variants(nodes), most))
    again = link_buckets(quarter_variants(first.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))), None)
    return first.where("not hot").select("a", "b").union(again.select("a", "b"))


def components(prints: DataFrame, most: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, row_hash, fp, component_id, root) of (doc_id, row_hash, fp) rows; root tells components without ids apart."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(nodes.select("fp"), most))
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(smallest, "root").select("fp", "component_id", "root")
    classes = nodes.join(linked, "fp", "left").select(
        "fp", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    return join_by_count(prints, materialise(classes), "fp").select("doc_id", "row_hash", "fp", "component_id", "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_hash, fp, component_id, root) of every row of df."""
    return components(materialise(fingerprints(df, id_col, text_col)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of documents; one row a document."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
