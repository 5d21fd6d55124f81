"""From raw documents to token ids: five stages, each a pass over what the one before kept.

Rows that share an id and a text are one document.  All stages but the last return the
columns that they were given, whatever their names.  Null ids are kept, null texts are texts without words; the
quality rules reject them, line dedup drops only texts whose lines are all removed, one text of each group without words stays in the near-dedup, and they have no
benchmark window and no token.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.llm.bpe import decode, encode, tokenizer_path
from gridlore.llm.common import materialise, read_table, row_hash, rows_in, shared_path
from gridlore.llm.decontaminate import contamination
from gridlore.llm.linededup import dedup_lines
from gridlore.llm.quality import quality_rules as judge_quality
from gridlore.llm.simhash import near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rows_in(docs, judge_quality(docs).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere; those with no word left go.

    n_chars follows the text where lines were removed.
    """
    out = dedup_lines(docs)
    kept = out.where((F.col("line_dedup.n_removed") == 0) | (F.col("line_dedup.n_lines") > F.col("line_dedup.n_removed")))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("line_dedup.n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest by id (nulls last), text hash and the other columns."""
    copies = near_duplicates(docs).groupBy("doc_id", "row_hash").agg(F.min("root").alias("root"), F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash", "n")).alias("first")
    winners = materialise(copies.groupBy("root").agg(first).select("first.*"))
    repeated = winners.where("n > 1")
    if repeated.isEmpty():
        return rows_in(docs, winners)
    same = rows_in(docs, repeated)
    row = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    one = same.groupBy(F.col("doc_id").cast("long").alias("_id"), row_hash(F.col("text")).alias("_hash")).agg(row).select("row.*")
    return rows_in(docs, winners.where("n = 1")).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return rows_in(docs, contamination(docs, read_table(spark, sf_dir, "benchmark")).where("not contaminated"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    path = tokenizer_path()
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded_text", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
