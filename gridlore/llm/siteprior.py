"""Quality by hierarchical empirical Bayes: document evidence under host and path priors.

A logistic classifier over character and repetition shares gives each document a probability
of being good.  Grouped sums of these give every host, and every path within a host, a Beta
posterior: a path is shrunk toward its host, a host toward the whole corpus, by strengths
that the method of moments estimates from the spread of the sites.  A document's prior is its
path's posterior without the document's own share; the classifier's evidence (its log odds
over those of a break-even document) moves that prior to the document's posterior.  Where
the break-even lies is chosen on labelled rows that the scoring weights have not seen.

The classifier is fitted on at most TRAIN_ROWS labelled rows, drawn by a hash of the id;
everything else covers all rows.  Without labels of both kinds the evidence is neutral.
Repeated labels of an id are averaged.  Null texts are empty texts, null hosts and paths are
sites of their own, null ids take part but have no label.  Repeated rows count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlore.llm.common import arrow_map, materialise, mix, read_table
from gridlore.llm.quality import duplicate_lines, repeated_words

TRAIN_ROWS = 20_000
KEEP_AT = 0.5
FOLDS = 5
CLASSES = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    "#*$%&<>",
    "|",
    "!",
    "?",
    ".,;:",
    "\"'`",
    "()[]{}",
    "@/\\=+_~^-",
    " \t",
    "\n",
)
IN_CLASS = np.zeros((256, len(CLASSES) + 1))
for _n, _chars in enumerate(CLASSES):
    IN_CLASS[[ord(c) for c in _chars], _n] = 1
IN_CLASS[0x80:, -1] = 1
N_FEATURES = len(CLASSES) + 1 + 6


def features_of(text: bytes) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    words = text.split()
    if not words:
        return out
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ IN_CLASS / len(text)
    out[: len(shares)] = np.sqrt(shares)
    n = len(words)
    lines = text.count(b"\n") + 1
    out[len(shares) :] = (
        np.log1p(n) / 5,
        min(1.0, len(text) / n / 20),
        repeated_words(words) / n,
        duplicate_lines(text) / lines,
        len(set(words)) / n,
        1.0 if n < 20 else 0.0,
    )
    return out


def measured(df: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """(doc_id, host, path, features) of every row."""
    narrow = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.col(path_col).cast("string").alias("path"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(part: pa.RecordBatch) -> dict:
        texts = part.column("text").cast(pa.binary()).to_pylist()
        found = np.stack([features_of(t or b"") for t in texts]).astype(np.float32)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), N_FEATURES)
        return {c: part.column(c) for c in ("doc_id", "host", "path")} | {"features": flat.cast(pa.list_(pa.float32()))}

    return arrow_map(narrow, run, "doc_id long, host string, path string, features array<float>", "text")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, and the intercept last, of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - pull * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def break_even(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """The log odds that best tell good from bad rows, each scored by weights of the other folds.

    Good and bad rows weigh the same in sum; among equals the widest gap decides.
    """
    z = np.zeros(len(y))
    for k in range(FOLDS):
        seen = fold != k
        if not 0 < y[seen].sum() < seen.sum():
            return 0.0
        w = fit(x[seen], y[seen])
        z[~seen] = x[~seen] @ w[:-1] + w[-1]
    order = np.argsort(z)
    z, y = z[order], y[order]
    bad_below = np.cumsum(1 - y)[:-1] / (1 - y).sum()
    good_below = np.cumsum(y)[:-1] / y.sum()
    gain, gap = bad_below - good_below, np.diff(z)
    gain[gap == 0] = -1
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = best[np.argmax(gap[best])]
    return float((z[at] + z[at + 1]) / 2)


def learn(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """(weights, log odds of a break-even document)."""
    truth = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("label_id"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).alias("good"))
    )
    share = min(1.0, most / max(1, truth.count()))
    drawn = truth.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < share * (1 << 30)) if share < 1 else truth
    found = rows.select("doc_id", "features").join(drawn, F.col("doc_id") == F.col("label_id"))
    table = found.select("label_id", "features", "good").orderBy("label_id", "features").limit(most).toArrow()
    y = np.asarray(table.column("good")).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(N_FEATURES + 1), 0.0
    x = np.array(table.column("features").to_pylist(), dtype=float)
    fold = mix(np.asarray(table.column("label_id")).view(np.uint64)) % np.uint64(FOLDS)
    return fit(x, y), break_even(x, y, fold)


def logit(p: Column) -> Column:
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(safe / (1 - safe))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def strength(sites: DataFrame, mean: Column, total: Column, spread: Column) -> float:
    """Pseudo-rows of the prior above: within-site variance over between-site variance."""
    r = sites.agg(
        F.sum(spread).alias("within"),
        F.sum(F.greatest(F.lit(0.0), total - 1)).alias("df"),
        F.sum(total * (mean - F.col("above")) ** 2).alias("between"),
        F.sum(total).alias("n"),
        F.count("*").alias("k"),
    ).first()
    if not r.n or not r.df or r.k < 2:
        return 10.0
    within = max(r.within / r.df, 1e-6)
    between = max((r.between - (r.k - 1) * within) / r.n, 1e-6)
    return float(min(max(within / between, 1.0), 10_000.0))


def posteriors(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    keep_at: float = KEEP_AT,
) -> DataFrame:
    """(doc_id, doc_score, host_posterior, path_posterior, quality, kept) of every row."""
    rows = materialise(measured(df, id_col, text_col, host_col, path_col))
    weights, even = learn(rows, labels, id_col, label_col)
    dot = F.aggregate(
        F.zip_with("features", F.array(*[F.lit(float(w)) for w in weights[:-1]]), lambda f, w: f * w),
        F.lit(float(weights[-1])),
        lambda a, b: a + b,
    )
    scored = rows.select("doc_id", "host", "path", logistic(dot).alias("p"))

    paths = materialise(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("q"))
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"))
    top = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n")).first()
    overall = (top.s + 0.5) / (top.n + 1) if top.n else 0.5
    host_mean = F.col("host_s") / F.col("host_n")
    host_strength = strength(
        hosts.withColumn("above", F.lit(overall)), host_mean, F.col("host_n"), F.col("host_q") - F.col("host_s") * host_mean
    )
    hosts = hosts.withColumn(
        "host_posterior", (F.lit(host_strength * overall) + F.col("host_s")) / (host_strength + F.col("host_n"))
    )
    upper = hosts.select(F.col("host").alias("of_host"), "host_posterior")
    sites = paths.join(upper, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    path_mean = F.col("s") / F.col("n")
    path_strength = strength(
        sites.withColumn("above", F.col("host_posterior")), path_mean, F.col("n"), F.col("q") - F.col("s") * path_mean
    )
    sites = sites.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "n", "s", "host_posterior")
    joined = scored.join(
        sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left"
    )
    others = (path_strength * F.col("host_posterior") + F.col("s") - F.col("p")) / (path_strength + F.col("n") - 1)
    return joined.select(
        "doc_id",
        F.col("p").alias("doc_score"),
        "host_posterior",
        ((path_strength * F.col("host_posterior") + F.col("s")) / (path_strength + F.col("n"))).alias("path_posterior"),
        logistic(logit(F.col("p")) - F.lit(even) + logit(others) - logit(F.lit(overall))).alias("quality"),
    ).withColumn("kept", F.col("quality") >= keep_at)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality posteriors of documents; source is the host, the language section its path."""
    return posteriors(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
