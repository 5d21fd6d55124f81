"""Writing: keyed upserts as transforms, day archives with a manifest, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A full replace by key: the greatest order stays, new before old on ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "_new")).alias("r")).select(*keys, "r.*")


def append_new(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows to append so that each key stands once, the least by order first; null keys never conflict."""
    rest = [c for c in incoming.columns if c != key]
    once = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    fresh = once.select(key, "r.*").join(existing.select(key), key, "left_anti")
    return fresh.unionByName(incoming.where(F.col(key).isNull()))


def write_days(df: DataFrame, path: str, files_a_day: int = 1, level: int = 19) -> None:
    """Replace the days that df has.  A day is dealt to files_a_day tasks by device and time, so a large day stays small tasks."""
    salt = F.pmod(F.xxhash64("device_id", "observed_at"), F.lit(files_a_day))
    (
        df.withColumn("day", F.to_date("observed_at"))
        .repartition("day", salt)
        .sortWithinPartitions("day", "device_id", "observed_at")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", str(level))
        .partitionBy("day")
        .parquet(path)
    )


def manifest(df: DataFrame) -> DataFrame:
    """Count, range and a digest of each day; the digest is a sum of row hashes, so order and files don't matter."""
    columns = sorted(c for c in df.columns if c != "day")
    day = F.col("day") if "day" in df.columns else F.to_date("observed_at")
    return df.groupBy(day.alias("day")).agg(
        F.count("*").alias("n"),
        F.min("observed_at").alias("first_at"),
        F.max("observed_at").alias("last_at"),
        F.sum(F.xxhash64(*columns).cast("decimal(28,0)")).alias("digest"),
    )


def prunable(raw: DataFrame, archived: DataFrame, cutoff: Column) -> DataFrame:
    """Days before cutoff whose archive holds just the rows of the raw table, by their manifests."""
    same = archived.select("day", F.col("n").alias("archived_n"), F.col("digest").alias("archived_digest"))
    return (
        raw.where(F.col("day") < cutoff)
        .join(same, "day")
        .where((F.col("n") == F.col("archived_n")) & (F.col("digest") == F.col("archived_digest")))
        .select("day", "n")
    )


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header in the given order; arrays, maps and structs as compact JSON."""
    nested = ("array", "map", "struct")
    flat = [F.to_json(c).alias(c) if dict(df.dtypes)[c].startswith(nested) else F.col(c) for c in columns]
    df.select(*flat).write.option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """A JSON object a line, nulls included."""
    df.write.option("ignoreNullFields", False).json(path)
