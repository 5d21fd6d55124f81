"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ORDER bytes, held as sorted arrays of
(context, byte) counts.  A byte costs -log of its probability in the longest context that
the tree has; where that context has not seen the byte, an escape is paid (method C:
distinct bytes over count plus distinct bytes) and the next shorter context is asked, with
the bytes of the longer one excluded.  The statistics are frozen after training, so the
cost of a byte is a function of ORDER + 1 bytes, and code lengths are exact sums.  The
language with the shortest code wins; ties go to the first name in alphabetical order.

Training counts come from a sample of labelled rows: about SAMPLE_ROWS a language, chosen
by a hash of the id, fewer where the model would have more than MODEL_CELLS cells.  All
(context, byte) pairs of the sample are kept.  ASCII letters are folded to lower case.

Null texts and texts without a letter are ``und`` with score 0, as is every text when
nothing could be learned.  Rows with a null language or id are never learned from.  Empty
tables give empty results.  Repeated rows are scored each.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlore.llm.common import arrow_map, materialise, read_table, text_bytes

ORDER = 3
SAMPLE_ROWS = 3000
#: Cells (context and byte, language) of the model, which is broadcast; all pairs of the sample are kept, and the sample is halved until they fit.
MODEL_CELLS = 1 << 25
LETTER = regex.compile(r"\p{L}")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
START = 0x0A


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER bytes before it as one integer, and the row offsets.

    Before the first byte of a row stand line ends.
    """
    data, offsets = text_bytes(column)
    lengths = np.diff(offsets)
    padded = np.full(len(data) + ORDER * len(lengths), START, np.uint32)
    place = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(lengths) + 1), lengths)
    padded[place] = FOLD[data]
    code = padded[place]
    for k in range(1, ORDER + 1):
        code = code | (padded[place - k] << np.uint32(8 * k))
    return code, offsets


class Tree:
    """Frozen PPM statistics of one language."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.symbols: list[np.ndarray] = []  # (context, byte) of each order
        self.counts: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.total: list[np.ndarray] = []
        self.distinct: list[np.ndarray] = []
        for k in range(ORDER + 1):
            keys, where = np.unique(codes.astype(np.int64) & ((1 << (8 * k + 8)) - 1), return_inverse=True)
            n = np.bincount(where, counts, len(keys))
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            self.symbols.append(keys)
            self.counts.append(n)
            self.contexts.append(contexts)
            self.total.append(np.bincount(of, n, len(contexts)))
            self.distinct.append(np.bincount(of, minlength=len(contexts)).astype(float))
        # what is left of the next shorter context once the bytes of this one are excluded
        self.left_total: list[np.ndarray] = [np.zeros(0)]
        self.left_distinct: list[np.ndarray] = [np.zeros(0)]
        for k in range(1, ORDER + 1):
            shorter = self.symbols[k] & ((1 << (8 * k)) - 1)
            seen = self.counts[k - 1][np.searchsorted(self.symbols[k - 1], shorter)]
            owner = np.searchsorted(self.contexts[k], self.symbols[k] >> 8)
            up = np.searchsorted(self.contexts[k - 1], self.contexts[k] & ((1 << (8 * (k - 1))) - 1))
            self.left_total.append(self.total[k - 1][up] - np.bincount(owner, seen, len(self.contexts[k])))
            self.left_distinct.append(self.distinct[k - 1][up] - self.distinct[k])

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Code length in nats of each (context, byte)."""
        codes = codes.astype(np.int64)
        out = np.zeros(len(codes))
        open_ = np.ones(len(codes), bool)
        above = np.full(len(codes), -1)  # the context one longer that was escaped from
        for k in range(ORDER, -1, -1):
            todo = np.flatnonzero(open_)
            own = codes[todo] & ((1 << (8 * k + 8)) - 1)
            at, known = self.find(self.contexts[k], own >> 8)
            todo, own, at = todo[known], own[known], at[known]
            fresh = above[todo] < 0
            total, distinct = self.total[k][at], self.distinct[k][at]
            if k < ORDER:
                total = np.where(fresh, total, self.left_total[k + 1][above[todo]])
                distinct = np.where(fresh, distinct, self.left_distinct[k + 1][above[todo]])
            spot, seen = self.find(self.symbols[k], own)
            whole = np.maximum(total + distinct, 1e-300)
            share = np.where(seen, self.counts[k][spot], np.where(distinct > 0, distinct, whole))
            out[todo] -= np.log(share / whole)
            open_[todo[seen]] = False
            above[todo] = at
        rest = max(1.0, 256 - self.distinct[0][0])
        out[open_] += np.log(rest)
        return out


class Model:
    """Trees of all languages, with the costs of every pair that any of them has seen in a hash table."""

    def __init__(self, entries: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(entries)
        self.trees = [Tree(*entries[lang]) for lang in self.langs]
        known = np.unique(np.concatenate([entries[lang][0] for lang in self.langs])).astype(np.uint32)
        self.costs = np.vstack([self.exact(known), np.zeros((1, len(self.langs)))])
        bits = max(10, int(np.ceil(np.log2(4 * len(known)))))
        self.shift = np.uint32(32 - bits)
        self.mask = np.uint32((1 << bits) - 1)
        self.slot_code = np.zeros(1 << bits, np.uint32)
        self.slot_row = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(known)), self.home(known)
        while len(todo):
            free = self.slot_row[at] < 0
            self.slot_row[at[free]] = todo[free]
            lost = self.slot_row[at] != todo
            self.slot_code[at[~lost]] = known[todo[~lost]]
            todo, at = todo[lost], (at[lost] + np.uint32(1)) & self.mask

    def home(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> self.shift

    def exact(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([t.costs(codes) for t in self.trees], axis=1)

    def totals(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language."""
        at = self.home(codes)
        row = self.slot_row[at]
        wrong = np.flatnonzero((row >= 0) & (self.slot_code[at] != codes))
        at = at[wrong]
        while len(wrong):
            at = (at + np.uint32(1)) & self.mask
            row[wrong] = self.slot_row[at]
            again = (row[wrong] >= 0) & (self.slot_code[at] != codes[wrong])
            wrong, at = wrong[again], at[again]
        cost = self.costs[row]  # the last line, for -1, is zero
        new = np.flatnonzero(row < 0)
        if len(new):
            rare, where = np.unique(codes[new], return_inverse=True)
            cost[new] = self.exact(rare)[where]
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(cost, offsets[:-1][full], axis=0)
        return out


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from rows with a language and an id."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not sizes:
        return None

    def count(part: pa.RecordBatch):
        langs = np.array(part.column("lang").to_pylist(), dtype=object)
        for lang in set(langs):
            codes, _ = grams(part.column("text").filter(pa.array(langs == lang)))
            keys, n = np.unique(codes, return_counts=True)
            yield {"lang": pa.array([lang] * len(keys), pa.string()), "code": keys.astype(np.int64), "n": n.astype(np.int64)}

    def counted(most: int) -> DataFrame:
        share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, most / n)))])
        draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
        sample = rows.where(draw < share[F.col(lang_col).cast("string")]).select(
            F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
        )
        each = arrow_map(sample, count, "lang string, code long, n long", "text", 4 << 20)
        return materialise(each.groupBy("lang", "code").agg(F.sum("n").alias("n")))

    summed = counted(sample_rows)
    while summed.select("code").distinct().count() * len(sizes) > MODEL_CELLS and sample_rows > 1:
        sample_rows //= 2
        summed = counted(sample_rows)
    table = summed.toArrow()  # at most MODEL_CELLS
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    codes, n = np.asarray(table.column("code")), np.asarray(table.column("n")).astype(float)
    entries = {lang: (codes[langs == lang], n[langs == lang]) for lang in set(langs)}
    return Model(entries) if entries else None


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): score is the posterior of the language under equal priors."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(part: pa.RecordBatch) -> dict:
        model = shared.value
        texts = part.column("text")
        named = np.array([has_letter(t) for t in texts.cast(pa.binary()).to_pylist()], bool)
        if model is None:
            named[:] = False
        pred = np.full(part.num_rows, "und", dtype=object)
        score = np.zeros(part.num_rows)
        if named.any():
            totals = model.totals(*grams(texts))
            best = totals.argmin(axis=1)
            gap = totals - totals.min(axis=1, keepdims=True)
            posterior = 1.0 / np.exp(-np.minimum(gap, 700.0)).sum(axis=1)
            pred[named] = np.array(model.langs, dtype=object)[best[named]]
            score[named] = posterior[named]
        return {"doc_id": part.column("doc_id"), "lang_pred": pa.array(pred.tolist(), pa.string()), "score": score}

    return arrow_map(narrow, run, "doc_id long, lang_pred string, score double", "text")


ASCII_LETTER = regex.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(ASCII_LETTER.search(text) or LETTER.search(text.decode("utf-8", "replace")))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of documents, learned from the three quarters that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
