"""Byte-level BPE over whole texts, encoded with a pair occurrence index.

A text is cut into pretokens.  All pretokens that a slice of the partition has not met yet
are laid end to end in one symbol array.  An index maps each adjacent pair that has a merge
rank to all its positions; active ranks are applied in ascending order from a heap, each
merge updating the lists of the pairs that it creates.  As a pair can only be made of
symbols that merges of lower rank have made, this gives the same result as repeatedly
merging the lowest ranked pair of each pretoken.

Nulls are empty texts and give no ids.  Special tokens that occur in a text become their
own ids, as in the tokenizers library.  Repeated rows are encoded each.  Only the id and
text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.llm.common import read_table, slices

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Bytes of pretokens and ids, as Python counts them, that each of two generations of a worker holds before it
#: makes room; one slice of texts may come on top.  What was dropped is encoded anew.
REMEMBERED_BYTES = 16 << 20
#: What a dictionary adds to an entry, about, and the longest pretoken that is remembered.
SLOT_BYTES = 104
REMEMBERED_LENGTH = 200
#: Text bytes that are encoded together; the arrays of the pair index are some 30 times as large at most.
ENCODE_BYTES = 2 << 20


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class BpeModel:
    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.first[b] = vocab[c]
        self.merged: list[int] = []
        self.parts: list[tuple[int, int]] = []
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merged.append(vocab[a + b])
            self.parts.append((vocab[a], vocab[b]))
        keys = np.array([a << 32 | b for a, b in self.parts], np.int64)
        self.key_ranks = np.argsort(keys)
        self.keys = keys[self.key_ranks]
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where the pair has none or touches a border."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.key_ranks[at], -1)

    def merge_all(self, pretokens: list[bytes]) -> list[bytes]:
        """Ids of each pretoken, as little-endian 32-bit integers."""
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
        size = int(bounds[-1])
        index_type = np.int32 if size < 1 << 31 else np.int64
        symbol = np.full(size + 1, -1, np.int32)  # -1 stands after each pretoken: no pair crosses it
        live = np.ones(size, bool)
        live[bounds[1:] - 1] = False
        symbol[:size][live] = self.first[np.frombuffer(b"".join(pretokens), np.uint8)]
        after = np.arange(1, size + 2, dtype=index_type)
        before = np.arange(-1, size, dtype=index_type)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(positions: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            found = self.ranks(symbol[positions], symbol[after[positions]])
            hit = found >= 0
            found, positions = found[hit], positions[hit]
            order = np.argsort(found, kind="stable")
            found, positions = found[order], positions[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, at in zip(found[np.concatenate([[0], cuts])].tolist() if len(found) else [], np.split(positions, cuts), strict=False):
                if r in places:
                    places[r].append(at)
                else:
                    places[r] = [at]
                    heapq.heappush(heap, r)

        index(np.flatnonzero(live))
        while heap:
            r = heapq.heappop(heap)
            a, b = self.parts[r]
            lists = places.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b:  # of overlapping occurrences the leftmost wins
                chosen, last = [], -1
                for i, j in zip(at.tolist(), after[at].tolist(), strict=True):
                    if i != last:
                        chosen.append(i)
                        last = j
                at = np.array(chosen, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.merged[r]
            symbol[gone] = -2
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            index(np.concatenate([at, left[left >= 0]]))
        ids = symbol[:size]
        live = ids >= 0
        counts = np.concatenate([[0], np.cumsum(live)])[bounds].tolist()
        flat = ids[live].astype("<u4").tobytes()
        return [flat[4 * counts[i] : 4 * counts[i + 1]] for i in range(len(pretokens))]

    def learn(self, pretokens: set[str]) -> list[str]:
        """Encode pretokens that are new; they share one occurrence index.  Returns those that are too long to be kept."""
        if self.held > REMEMBERED_BYTES:
            self.older, self.recent, self.held = self.recent, {}, 0
        recent, older = self.recent, self.older
        new, long = [], []
        for p in pretokens.difference(recent):
            if p in older:
                recent[p] = older[p]
                self.held += sys.getsizeof(p) + sys.getsizeof(recent[p]) + SLOT_BYTES
            else:
                new.append(p)
        if new:
            new.sort()
            for p, ids in zip(new, self.merge_all([p.encode() for p in new]), strict=True):
                recent[p] = ids
                if len(p) > REMEMBERED_LENGTH:
                    long.append(p)
                else:
                    self.held += sys.getsizeof(p) + sys.getsizeof(ids) + SLOT_BYTES
        return long

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        plans: list[list] = []
        seen: set[str] = set()
        for text in texts:
            plan: list = []
            for n, piece in enumerate(self.cut.split(text) if self.cut else [text]):
                if n % 2:
                    plan.append(self.special[piece].to_bytes(4, "little"))
                elif piece:
                    plan.append(found := PRETOKEN.findall(piece))
                    seen.update(found)
            plans.append(plan)
        long = self.learn(seen)
        get = self.recent.__getitem__
        out = [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in plan]) for plan in plans]
        for p in long:
            del self.recent[p]
        return out

    def decode(self, ids: bytes) -> str:
        """Text of little-endian 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_MODELS: dict[str, BpeModel] = {}


def model_of(tokenizer_json: str) -> BpeModel:
    """One model a worker process, whatever the number of tasks that it runs."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = BpeModel(tokenizer_json)
    return _MODELS[key]


def share_tokenizer(spark: SparkSession, path: str):
    """Send the vocabulary file, whose size does not depend on the data, to all executors."""
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > 64 << 20:
        raise ValueError(f"{path} has {len(text)} characters; a vocabulary of at most 64 MB is broadcast")
    return spark.sparkContext.broadcast(text)


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids are the token ids as little-endian unsigned 32-bit integers."""
    shared = share_tokenizer(df.sparkSession, tokenizer_path)
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                texts = part.column("text").fill_null("").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(model.encode_batch(texts), pa.binary())], ["doc_id", "ids"]
                )

    return narrow.mapInArrow(run, "doc_id long, ids binary")


def decode(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds decoded_text to (doc_id, ids); null ids give an empty text."""
    shared = share_tokenizer(df.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                texts = [model.decode(i or b"") for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())],
                    ["doc_id", "ids", "decoded_text"],
                )

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded_text string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(documents: DataFrame, path: str) -> DataFrame:
    both = decode(encode(documents, path), path)
    return both.select(
        "doc_id",
        F.floor(F.octet_length(F.coalesce("ids", F.lit(b""))) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce("ids", F.lit(b"")), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.coalesce("decoded_text", F.lit("")), "UTF-8"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of documents; one row a document."""
    return digests(read_table(spark, sf_dir, "documents"), tokenizer_path())
