"""Appending polls from a stream: samples with their register rows, and errors, all of a batch or nothing of it.

A micro-batch goes to a folder of its own in each table, and to the ledger last.  Readers take the batches in the ledger, so a sample is never
seen without its registers.  A batch that is run again overwrites its own folders, or does nothing if the ledger has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.sources.maintain import read_or_none

TABLES = ("samples", "register_values", "poll_errors")
LONGEST_ERROR = 1000


def split_polls(polls: DataFrame) -> dict[str, DataFrame]:
    """The three tables of polls: (sample_id, device_id, observed_at, latency_ms, profile, error, values).

    values is an array of (name, address, function, raw, number, flag, text, unit); a flag is a text, not a number.  A poll with an error
    is an error and nothing else; a poll without values is a sample without registers.
    """
    good = polls.where("error is null")
    v = F.col("v")
    flag = F.when(v["flag"].isNotNull(), F.when(v["flag"], "True").otherwise("False"))
    values = good.select("sample_id", F.explode("values").alias("v")).select(
        "sample_id",
        v["name"].alias("register_name"),
        v["address"].alias("address"),
        v["function"].alias("function"),
        F.to_json(v["raw"]).alias("raw_json"),
        F.when(v["flag"].isNull(), v["number"]).alias("numeric_value"),
        F.when(v["number"].isNull() | v["flag"].isNotNull(), F.coalesce(flag, v["text"])).alias("text_value"),
        v["unit"].alias("unit"),
    )
    return {
        "samples": good.select("sample_id", "device_id", "observed_at", "latency_ms", "profile"),
        "register_values": values,
        "poll_errors": polls.where("error is not null").select("sample_id", "device_id", "observed_at", "error"),
    }


def ledger(spark: SparkSession, root: str) -> DataFrame:
    return read_or_none(spark, f"{root}/ledger", "batch long, rows long")


def write_batch(polls: DataFrame, batch_id: int, root: str) -> None:
    spark = polls.sparkSession
    if ledger(spark, root).where(F.col("batch") == batch_id).take(1):
        return
    held = polls.persist()
    try:
        for name, table in split_polls(held).items():
            table.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        held.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{root}/ledger/batch={batch_id}")
    finally:
        held.unpersist()


def append_polls(stream: DataFrame, root: str, **options: object):
    """Start the stream; options go to its trigger."""
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, root))
        .option("checkpointLocation", f"{root}/state")
        .trigger(**(options or {"availableNow": True}))
        .start()
    )


def appended(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a table, of the batches that are whole."""
    return spark.read.parquet(f"{root}/{name}").join(ledger(spark, root).select("batch"), "batch", "left_semi").drop("batch")


def device_status(samples: DataFrame, errors: DataFrame) -> DataFrame:
    """(device_id, status, last_seen, last_error) after the last sample or error; a sample clears the error, whose first characters are kept."""
    told = samples.select("device_id", "observed_at", "sample_id", F.lit(None).cast("string").alias("error")).unionByName(
        errors.select("device_id", "observed_at", "sample_id", F.substring("error", 1, LONGEST_ERROR).alias("error"))
    )
    last = F.max_by("error", F.struct("observed_at", "sample_id"))
    return told.groupBy("device_id").agg(last.alias("last_error"), F.max(F.when(F.col("error").isNull(), F.col("observed_at"))).alias("last_seen")).withColumn(
        "status", F.when(F.col("last_error").isNull(), "online").otherwise("error")
    )
