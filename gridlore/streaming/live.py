"""The same reads over streams: rollups, first sightings, changes and rate limits.

State of a key is one value, kept by Spark's state store.  Within a micro-batch the rows of a
key are put in order; rows that come in a later batch are later, as in a log that is appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ORDER = ["observed_at", "sample_id"]


def timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", late)


def rollup(stream: DataFrame, keys: list[str], seconds: int, late: str = "1 hour") -> DataFrame:
    """Closed buckets, each given once; rows later than the watermark are left to the batch rebuild of their day."""
    v, at = F.col("numeric_value"), F.struct(*ORDER)
    return (
        timed(stream, late)
        .where(v.isNotNull())
        .groupBy(*keys, F.window("observed_at", f"{seconds} seconds").alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
            F.avg(v).alias("mean"),
            F.min_by(v, at).alias("first_value"),
            F.max_by(v, at).alias("last_value"),
        )
        .select(*keys, F.unix_seconds("w.start").alias("bucket_start"), "n", "low", "high", "mean", "first_value", "last_value")
    )


def first_sightings(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, so that memory stays bounded."""
    return timed(stream, late).dropDuplicatesWithinWatermark(keys)


def changes(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose state differs from the one before in their series, with that one."""
    columns = [*keys, *ORDER, "state"]
    rows = stream.where("state is not null").select(*columns)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        found = pd.concat(list(frames)).sort_values(ORDER)
        found["previous"] = found["state"].shift(1)
        if state.exists:
            found.iloc[0, found.columns.get_loc("previous")] = state.get[0]
        state.update((found["state"].iloc[-1],))
        yield found[found["previous"].notna() & (found["previous"] != found["state"])]

    return rows.groupBy(*keys).applyInPandasWithState(
        step, f"{fields}, previous string", "last string", "append", GroupStateTimeout.NoTimeout
    )


def rate_limited(stream: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Rows at least ``seconds`` after the last one kept in their series, over batches too."""
    rows = stream.select(*keys, *ORDER, F.unix_micros(F.col("observed_at").cast("timestamp")).alias("micros"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        found = pd.concat(list(frames)).sort_values(ORDER)
        last, kept = (state.get[0] if state.exists else None), []
        for now in found["micros"]:
            kept.append(last is None or now - last >= seconds * 1_000_000)
            last = now if kept[-1] else last
        state.update((last,))
        yield found[kept]

    return rows.groupBy(*keys).applyInPandasWithState(step, fields, "last long", "append", GroupStateTimeout.NoTimeout).drop("micros")


def changed_snapshots(stream: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Times at which the columns of a key hold something else than before, by a digest of them."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return changes(stream.withColumn("state", digest), keys)


def drain(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there now, and read what it has written under path."""
    run = f"{path}/{uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start(f"{run}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{run}/rows")
