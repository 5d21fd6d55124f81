"""Training-order materialisation: token sequences in fixed-stride binary shards.

Texts are encoded, an end token is added, and the ids are cut into sequences of SEQ_LEN (the
last one of a document is padded with the end token).  Sequences are numbered in the order of
the encoded table, which is written once: input partitions in order, rows in order.  A keyed
Feistel permutation with cycle walking maps that number to a slot of the training order, one
to one.  Slots are dealt by range to shards of SHARD_SLOTS records; each shard is one file in
which slot s is at byte (s mod SHARD_SLOTS) * stride.  A reader resumes at any slot by
seeking, and reads on.

A shard is written under a temporary name and renamed, so a task that runs again, on another
machine or twice at once, leaves the same file.  The encoded table lies in the shared folder
until the shards are written; the driver only sees its number of sequences by partition.
Shards are written in WAVES ranges of slots, one after the other, so that the shuffle never
holds more than that share of the output, and a stopped run keeps its finished waves.

Null texts are empty: a document of one sequence that holds the end token.  Null ids are
sequences of id -1 in records.  Repeated rows have sequences each.  Only the id and text
columns are read.

Record: doc_id (int64), place in the document (int32), number of real tokens (int32), then
SEQ_LEN ids as unsigned 16-bit integers, all little-endian.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.llm.bpe import share_tokenizer, tokenizer_path
from gridlore.llm.common import read_table, shared_path, shuffles_cleaned, slices

SEQ_LEN = 512
SHARD_SLOTS = 4096
WAVES = 4
KEY = 20240229
ROUNDS = 6
HEADER = 16
#: Fixed value: the pattern that cuts texts before byte pairs are merged, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def round_keys(key: int, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}:{n}".encode()).digest()[:8], "little") for n in range(rounds)]


def feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    """A permutation of the integers under 2^(2 * half)."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        f = (right + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        left, right = right, left ^ ((f >> np.uint64(32)) & mask)
    return (left << np.uint64(half)) | right


def slots_of(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """Slots under ``total``; numbers that leave the range are walked along their cycle."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    keys = round_keys(key)
    out = feistel(numbers.astype(np.uint64), half, keys)
    while (outside := out >= np.uint64(total)).any():
        out[outside] = feistel(out[outside], half, keys)
    return out.astype(np.int64)


_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder_of(ranks: str) -> tiktoken.Encoding:
    """One encoder a worker process."""
    name = hashlib.sha256(ranks.encode()).hexdigest()
    if name not in _ENCODERS:
        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[name]


def encoded(df: DataFrame, path: str, id_col: str, text_col: str, seq_len: int) -> DataFrame:
    """(part, first, doc_id, n_seq, ids): ids as unsigned 16-bit integers, end token included.

    first counts the sequences that the same input partition holds before this document.
    """
    shared = share_tokenizer(df.sparkSession, path)
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(shared.value)
        end = encoder.max_token_value + 1
        if end >= 1 << 16:
            raise ValueError("ids of this vocabulary do not fit in 16 bits")
        number, part_id = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = part.column("text").fill_null("").to_pylist()
                ids = [np.array([*encoder.encode_ordinary(t), end], "<u2").tobytes() for t in texts]
                n_seq = np.array([-(-len(i) // (2 * seq_len)) for i in ids], np.int64)
                first = number + np.cumsum(n_seq) - n_seq
                number += int(n_seq.sum())
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": np.full(len(ids), part_id, np.int32),
                        "first": first,
                        "doc_id": part.column("doc_id"),
                        "n_seq": n_seq,
                        "ids": pa.array(ids, pa.binary()),
                    }
                )

    return narrow.mapInArrow(run, "part int, first long, doc_id long, n_seq long, ids binary")


def offsets_of_parts(table: DataFrame) -> tuple[np.ndarray, int]:
    """Sequences before each part, and in all; the driver sees one row an input partition."""
    sizes = table.groupBy("part").agg(F.sum("n_seq").alias("n")).toArrow()
    part, n = np.asarray(sizes.column("part")), np.asarray(sizes.column("n"))
    counts = np.zeros(int(part.max()) + 1 if len(part) else 0, np.int64)
    counts[part] = n
    return np.cumsum(counts) - counts, int(counts.sum())


def sequences(
    table: DataFrame, offsets: np.ndarray, total: int, seq_len: int, key: int, shard_slots: int, low: int, high: int
) -> DataFrame:
    """(shard, slot, record) of every sequence with a slot from low to below high."""
    shared = table.sparkSession.sparkContext.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = 2 * seq_len
        for batch in batches:
            for part in slices(batch, "ids", 2 << 20):
                n_seq = np.asarray(part.column("n_seq"))
                first = np.asarray(part.column("first")) + shared.value[np.asarray(part.column("part"))]
                place = np.arange(n_seq.sum()) - np.repeat(np.cumsum(n_seq) - n_seq, n_seq)
                slot = slots_of(np.repeat(first, n_seq) + place, total, key)
                on = np.flatnonzero((slot >= low) & (slot < high))
                slot, owner = slot[on], np.repeat(np.arange(len(n_seq)), n_seq)[on].tolist()
                docs = part.column("doc_id").fill_null(-1).to_pylist()
                all_ids = part.column("ids").to_pylist()
                records = []
                for n, k in zip(owner, place[on].tolist(), strict=True):
                    own = all_ids[n][k * stride : (k + 1) * stride]
                    size = len(own) // 2
                    head = docs[n].to_bytes(8, "little", signed=True) + k.to_bytes(4, "little") + size.to_bytes(4, "little")
                    records.append(head + own + all_ids[n][-2:] * (seq_len - size))
                yield pa.RecordBatch.from_pydict(
                    {"shard": slot // shard_slots, "slot": slot, "record": pa.array(records, pa.binary())}
                )

    return table.mapInArrow(run, "shard long, slot long, record binary")


def shard_name(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def write_files(records: DataFrame, out_dir: str, stride: int, first_shard: int, shards: int) -> DataFrame:
    """One file a shard of the ``shards`` from ``first_shard`` on; returns (shard, first_slot, n_slots, n_bytes, sha256)."""
    place = (F.col("shard") - F.lit(first_shard)).cast("int")  # shards are ranges of slots: one a partition, and none empty
    dealt = records.repartitionById(max(1, shards), place).sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out_dir)
        now, stream, temp, digest, count, first = None, None, None, None, 0, 0
        done: list[tuple] = []

        def close() -> None:
            stream.close()
            store.move(temp, f"{root}/{shard_name(now)}")
            done.append((now, first, count, count * stride, digest.hexdigest()))

        for batch in batches:
            shard, slot = np.asarray(batch.column("shard")), np.asarray(batch.column("slot"))
            record = batch.column("record")
            for lo, hi in zip(cuts := np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1]), [*cuts[1:], len(shard)], strict=True):
                if shard[lo] != now:
                    if now is not None:
                        close()
                    now, count, first, digest = int(shard[lo]), 0, int(slot[lo]), hashlib.sha256()
                    temp = f"{root}/.{shard_name(now)}.{uuid.uuid4().hex}"
                    stream = store.open_output_stream(temp)
                raw = b"".join(record.slice(lo, hi - lo).to_pylist())
                if not np.array_equal(slot[lo:hi], np.arange(first + count, first + count + hi - lo)):
                    raise ValueError(f"shard {now} has missing or repeated slots")
                stream.write(raw)
                digest.update(raw)
                count += int(hi - lo)
        if now is not None:
            close()
        if done:
            names = ("shard", "first_slot", "n_slots", "n_bytes", "sha256")
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)))

    return dealt.mapInArrow(run, "shard long, first_slot long, n_slots long, n_bytes long, sha256 string")


def materialise_order(
    df: DataFrame,
    out_dir: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    shard_slots: int = SHARD_SLOTS,
    key: int = KEY,
    waves: int = WAVES,
) -> DataFrame:
    """Write all shards under out_dir and return the manifest, a table written beside them."""
    spark = df.sparkSession
    store, root = fs.FileSystem.from_uri(out_dir)
    store.create_dir(root, recursive=True)
    table_dir = f"{out_dir}/encoded"
    encoded(df, tokenizer, id_col, text_col, seq_len).write.mode("overwrite").option("compression", "zstd").parquet(table_dir)
    table = spark.read.parquet(table_dir)
    offsets, total = offsets_of_parts(table)
    shards = -(-total // shard_slots)
    waves = max(1, min(waves, shards))
    parts = []
    with shuffles_cleaned(spark):
        for wave in range(waves):
            first, last = wave * shards // waves, (wave + 1) * shards // waves
            records = sequences(table, offsets, total, seq_len, key, shard_slots, first * shard_slots, last * shard_slots)
            written = write_files(records, out_dir, HEADER + 2 * seq_len, first, last - first)
            parts.append(f"{out_dir}/manifest-{wave}")
            written.write.mode("overwrite").parquet(parts[-1])
    store.delete_dir(f"{root}/encoded")
    return spark.read.parquet(*parts)


def read_shards(manifest: DataFrame, out_dir: str, seq_len: int = SEQ_LEN, from_slot: int = 0) -> DataFrame:
    """(slot, doc_id, place, n_tokens, ids) from a slot on, each file read in one pass from its seek."""
    stride = HEADER + 2 * seq_len
    wanted = manifest.where(F.col("first_slot") + F.col("n_slots") > from_slot).select("shard", "first_slot", "n_slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for r in batch.to_pylist():
                skip = max(0, from_slot - r["first_slot"])
                with store.open_input_file(f"{root}/{shard_name(r['shard'])}") as stream:
                    stream.seek(skip * stride)
                    at = r["first_slot"] + skip
                    while raw := stream.read(1024 * stride):
                        lines = np.frombuffer(raw, np.uint8).reshape(-1, stride)
                        n = len(lines)
                        ids = np.ascontiguousarray(lines[:, HEADER:])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "slot": np.arange(at, at + n),
                                "doc_id": np.ascontiguousarray(lines[:, :8]).view("<i8").ravel(),
                                "place": np.ascontiguousarray(lines[:, 8:12]).view("<i4").ravel(),
                                "n_tokens": np.ascontiguousarray(lines[:, 12:16]).view("<i4").ravel(),
                                "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
                            }
                        )
                        at += n

    return wanted.repartition("shard").mapInArrow(run, "slot long, doc_id long, place int, n_tokens int, ids binary")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of documents in training order, read back: one row a sequence."""
    out_dir = shared_path(spark, "training-order")
    manifest = materialise_order(read_table(spark, sf_dir, "documents"), out_dir, tokenizer_path("byte_bpe_50k.tiktoken"))
    read = read_shards(manifest, out_dir)
    return read.select(
        "slot",
        "doc_id",
        F.col("place").cast("long").alias("place"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
    )
