"""The driver's tables seen as telemetry: samples, states, daily records, polls and register words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numeric and one state value a row, keyed by (device_id, observed_at, sample_id)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"),
        F.col("user_id").alias("device_id"),
        F.expr("user_id div 3").alias("controller_id"),
        F.col("ts").alias("observed_at"),
        F.col("event_type").alias("register_name"),
        F.when(~F.isnan("value"), F.col("value")).alias("numeric_value"),
        F.col("event_type").alias("state"),
    )


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.expr("o_custkey div 10").alias("device_id"),
        F.expr("date_add(date'2024-01-01', CAST(o_orderkey % 30 AS INT))").alias("controller_day"),
        F.col("o_orderdate").alias("retrieved_at"),
        F.col("o_orderkey").alias("record_id"),
        F.col("o_totalprice").alias("charge_wh"),
        (F.col("o_orderstatus") != "P").alias("is_complete"),
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("device_id"),
        F.col("l_shipdate").alias("observed_at"),
        F.col("l_extendedprice").alias("latency_ms"),
        F.col("l_quantity").alias("interval_s"),
        F.col("l_linenumber").cast("long").alias("request_count"),
        (F.col("l_returnflag") != "R").alias("success"),
        (F.col("l_discount") * 1000).alias("bus_percent"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of 16-bit register words."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.expr("(l_partkey * 7919) % 65536").alias("w0"),
        F.expr("(l_suppkey * 104729 + l_linenumber) % 65536").alias("w1"),
    )
