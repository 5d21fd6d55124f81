"""Quality rules with adaptive thresholds.

One pass over the texts gives each document its counts.  Four signals made of them go into
mergeable quantile sketches: logarithmic histograms whose buckets are grouped and counted
by language and source, so that merging is adding counts, in any order and with the same
result.  Documents that fail the base rules are not in the sketches.  Zeros have a bucket of their own.

A signal's fence is found in two ways, and the lower one holds:

* The value that all but RARE of the group's documents stay under.  So a rule costs a group about that share of its documents, whatever their
  values are.  The quantile of a source is drawn toward that of its language and that toward the corpus, with the weight of
  MIN_ROWS documents, so fences move smoothly as a group grows.  A source's is not above its language's, so a
  source with much junk cannot excuse itself; a language may differ from the corpus.
* The middle of a gap.  Where the values of at most ODD of the documents lie beyond a stretch that is empty by a factor of GAP or more, they are another kind
  of document.  The stretch begins at one event a document (one symbol, one line) or above, so that a first
  symbol or repeated line is no gap.  The gap of a language counts, or else that of the corpus.

No fence is a constant.  What is left to the first way is junk in over ODD of a whole language and corpus, or without a gap.
Verdicts come from joining documents to the fences of their language and source.

Null and empty texts have no words and fail the base rules.  Null languages and sources are
groups of their own.  Repeated rows count and are judged each.  Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridlore.llm.common import arrow_map, materialise, read_table, row_hash

MIN_WORDS = 50
#: Documents that the merged quantiles weigh as much as, beside those of a group.
MIN_ROWS = 200
#: Share of a group that a signal may reject without a gap, share of documents that may lie beyond one, and its factor.
RARE = 0.005
ODD = 0.1
GAP = 8.0
#: Buckets of a sketch grow by this factor: quantiles are within 1 % of the true value.
GAMMA = 1.02
#: Where buckets begin; smaller shares count as zero.
LEAST = 1e-6
#: The counts that one event of a signal is a share of, and how many of them it is: a line that stands twice repeats two lines' words.
WHOLE = {"symbol_share": ("word_chars", 1), "dup_line_share": ("n_lines", 1), "repeat_share": ("n_lines", 2), "upper_share": ("word_chars", 1)}
SIGNALS = ("symbol_share", "dup_line_share", "repeat_share", "upper_share")

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    count, reach = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            count += i + 3 - max(i, reach)
            reach = i + 3
    return count


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    count = 0
    for line in lines:
        if line in seen:
            count += bool(line.split())
        else:
            seen.add(line)
    return count


def measure_text(text: bytes) -> tuple[int, int, int, int, int, int, int]:
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    return (
        len(words),
        int(np.count_nonzero(((raw & 0xC0) != 0x80) & ~BLANK[raw])),
        int(np.count_nonzero(SYMBOLS[raw])),
        duplicate_lines(text),
        repeated_words(words),
        text.count(b"\n") + 1,
        int(np.count_nonzero(UPPER[raw])),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts of every row; the columns in keep are carried as strings."""
    narrow = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        row_hash(F.col(text_col)).alias("row_hash"),
        *[F.col(c).cast("string").alias(c) for c in keep],
    )
    schema = "doc_id long, row_hash long, " + "".join(f"`{c}` string, " for c in keep) + ", ".join(f"{c} long" for c in COUNTS)

    def run(part: pa.RecordBatch) -> dict:
        texts = part.column("text").cast(pa.binary()).to_pylist()
        found = np.array([measure_text(t or b"") for t in texts], np.int64).reshape(len(texts), len(COUNTS))
        return {c: part.column(c) for c in ("doc_id", "row_hash", *keep)} | {
            c: found[:, n] for n, c in enumerate(COUNTS)
        }

    return arrow_map(narrow, run, schema, "text")


def with_signals(counts: DataFrame) -> DataFrame:
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return counts.select(
        "*",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def bucket_of(value: Column) -> Column:
    return F.when(value < LEAST, -1).otherwise(F.floor(F.log(value / LEAST) / F.log(F.lit(GAMMA)))).cast("int")


def value_of(bucket: Column) -> Column:
    return F.when(bucket < 0, 0.0).otherwise(LEAST * F.pow(F.lit(GAMMA), bucket + 0.5))


def one_event(signals: DataFrame, signal: str) -> Column:
    """The share that one event makes in a document; the least share where its counts are not told."""
    whole, size = WHOLE[signal]
    if whole not in signals.columns:
        return F.lit(LEAST)
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(float(size)), F.col(whole)), F.lit(LEAST)))


def sketches(signals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., signal, bucket, n, unit): log histograms.  Bucket -1 holds values of zero; unit adds up the buckets of one event."""
    pairs = [F.struct(F.lit(s).alias("signal"), F.col(s).alias("value"), bucket_of(one_event(signals, s)).alias("unit")) for s in SIGNALS]
    long = signals.where("not base_failed").select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.*")
    return long.groupBy(*by, "signal", bucket_of(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("unit").cast("long").alias("unit"))


def quantiles(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., signal, total, tail, gap) of each group: documents, the value that all but RARE of them stay under, the middle of a gap or null.

    A gap ends at a bucket whose documents and those above are ODD of the group at most; of several the widest counts, the lowest among equals.  One event is in
    the middle of its buckets.
    """
    group = Window.partitionBy(*by, "signal")
    up = group.orderBy("bucket")
    ranked = sketch.select(
        *by,
        "signal",
        "bucket",
        F.sum("n").over(group).alias("total"),
        F.sum("n").over(up).alias("upto"),
        (F.sum("n").over(group) - F.sum("n").over(up) + F.col("n")).alias("beyond"),
        F.floor(F.sum("unit").over(group) / F.sum("n").over(group)).cast("int").alias("unit"),
        F.lag("bucket").over(up).alias("before"),
    )
    low = F.greatest("before", "unit")
    width = F.col("bucket") - low
    wide = (F.col("bucket") >= 0) & (width * F.log(F.lit(GAMMA)) >= F.log(F.lit(GAP))) & (F.col("beyond") <= ODD * F.col("total"))
    middle = LEAST * F.pow(F.lit(GAMMA), (F.col("bucket") + low) / 2.0 + 0.5)
    return ranked.groupBy(*by, "signal").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") >= (1 - RARE) * F.col("total"), value_of(F.col("bucket")))).alias("tail"),
        F.min_by(F.when(wide, middle), F.when(wide, F.struct(-width, "bucket"))).alias("gap"),
    )


def fences(own: DataFrame, groups: DataFrame, lang_col: str, source_col: str, weight: int) -> DataFrame:
    """(fence_lang, fence_source, a fence for each signal) of the groups, from the sketches of sources."""
    add = lambda by: own.groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"), F.sum("unit").alias("unit"))  # noqa: E731  sketches merge
    same = lambda other, cols: [F.col(f"g.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in (*cols, "signal")]
    total = quantiles(add(()), ()).select("signal", F.col("tail").alias("all_tail"), F.col("gap").alias("all_gap"))
    each = groups.crossJoin(F.broadcast(total))  # four rows

    def drawn(of: str, merged: Column) -> Column:
        """The tail of a group, drawn toward that of the merged sketch; a group may have no sketch."""
        n = F.coalesce(F.col(f"{of}.total"), F.lit(0))
        return (n * F.coalesce(F.col(f"{of}.tail"), F.lit(0.0)) + weight * merged) / (n + weight)

    of_lang = drawn("l", F.col("all_tail"))
    of_source = F.least(drawn("s", of_lang), of_lang) * GAMMA
    gap = F.coalesce("l.gap", "all_gap")
    return (
        each.alias("g")
        .join(quantiles(add((lang_col,)), (lang_col,)).alias("l"), same("l", (lang_col,)), "left")
        .join(quantiles(own, (lang_col, source_col)).alias("s"), same("s", (lang_col, source_col)), "left")
        .groupBy(F.col(f"g.{lang_col}").alias("fence_lang"), F.col(f"g.{source_col}").alias("fence_source"))
        .pivot("g.signal", list(SIGNALS))
        .agg(F.first(F.least(of_source, gap)))
        .select("fence_lang", "fence_source", *[F.col(n).alias(f"{n}_fence") for n in SIGNALS])
    )


def judge(signals: DataFrame, lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """Adds kept: neither the base rules nor a fence of the document's group rejects it."""
    own = materialise(sketches(signals, (lang_col, source_col)))
    groups = signals.select(lang_col, source_col).distinct()
    chosen = fences(own, groups, lang_col, source_col, min_rows)
    joined = signals.join(
        chosen,
        signals[lang_col].eqNullSafe(chosen["fence_lang"]) & signals[source_col].eqNullSafe(chosen["fence_source"]),
        "left",
    )
    odd = [F.col(n) > F.col(f"{n}_fence") for n in SIGNALS]
    rejected = F.lit(False)
    for o in odd:
        rejected = rejected | F.coalesce(o, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("fence_lang", "fence_source")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, signals, fences and verdict of every row."""
    return judge(with_signals(materialise(measure(df, id_col, text_col))))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts on documents; one row a document."""
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
