"""Time-series reads: buckets, statistics, latest values, runs, transitions and tiers.

All transforms take (sample_id, device_id, observed_at, register_name, numeric_value, state)
and group by the key columns that the caller names.  Order within a series is always
(observed_at, sample_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ORDER = ("observed_at", "sample_id")


def at() -> Column:
    return F.struct(*ORDER)


def order_key(df: DataFrame, time: str = "observed_at", row: str = "sample_id") -> Column:
    """The order of (time, row) as one number of fixed width, so that first and last values are hash aggregates; null rows go first.

    Other types than times and whole numbers have their order as a struct, for which Spark sorts.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    if kinds[row] not in ("byte", "short", "integer", "long") or not kinds[time].startswith("timestamp"):
        return F.struct(time, row)
    span = F.lit(str(1 << 64)).cast("decimal(20,0)")
    place = F.coalesce(F.col(row).cast("decimal(20,0)"), F.lit(str(-(1 << 63))).cast("decimal(20,0)"))
    return F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(18,0)") * span + place


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def between(df: DataFrame, start: Column | None = None, end: Column | None = None, column: str = "observed_at") -> DataFrame:
    """Half-open range, each side optional; the conditions reach the scan."""
    if start is not None:
        df = df.where(F.col(column) >= start)
    if end is not None:
        df = df.where(F.col(column) < end)
    return df


def in_scope(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the devices that a membership table (device_id, controller_id) names, under their controller."""
    return df.drop("controller_id").join(members, "device_id")


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(epoch_seconds(ts) / seconds).cast("long") * seconds


def numeric_buckets(df: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    v, place = F.col("numeric_value"), F.col("_place")
    return (
        df.where(v.isNotNull())
        .withColumn("_place", order_key(df))
        .groupBy(*keys, bucket(F.col("observed_at"), seconds).alias("bucket_start"))
        .agg(
            F.count("*").alias("n"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
            F.round(F.avg(v), 6).alias("mean"),
            F.min_by(v, place).alias("first_value"),
            F.max_by(v, place).alias("last_value"),
        )
    )


def with_changes(df: DataFrame, keys: list[str]) -> DataFrame:
    """changed is 1 where a state differs from the one before in its series; the first never does."""
    series = Window.partitionBy(*keys).orderBy(*ORDER)
    before = F.lag("state").over(series)
    return df.where(F.col("state").isNotNull()).withColumn(
        "changed", F.when(before.isNotNull() & (before != F.col("state")), 1).otherwise(0)
    ).withColumn("previous", before)


def state_buckets(df: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """A change over a bucket's edge counts in the later bucket."""
    return (
        with_changes(df, keys)
        .groupBy(*keys, bucket(F.col("observed_at"), seconds).alias("bucket_start"))
        .agg(
            F.count("*").alias("n"),
            F.min_by("state", at()).alias("first_state"),
            F.max_by("state", at()).alias("last_state"),
            F.sum("changed").alias("transitions"),
        )
    )


def numeric_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    v, ts = F.col("numeric_value"), F.col("observed_at")
    first, last = F.min_by(v, at()), F.max_by(v, at())
    return (
        df.where(v.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
            F.round(F.avg(v), 6).alias("mean"),
            first.alias("first_value"),
            last.alias("last_value"),
            F.min(ts).alias("first_at"),
            F.max(ts).alias("last_at"),
            F.min_by(ts, F.struct(v, *ORDER)).alias("low_at"),
            F.min_by(ts, F.struct(-v, *ORDER)).alias("high_at"),
            F.round(last - first, 6).alias("delta"),
            (F.max(epoch_seconds(ts)) - F.min(epoch_seconds(ts))).alias("duration_s"),
        )
    )


def state_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return (
        with_changes(df, keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.min_by("state", at()).alias("first_state"),
            F.max_by("state", at()).alias("last_state"),
            F.min("observed_at").alias("first_at"),
            F.max("observed_at").alias("last_at"),
            F.sum("changed").alias("transitions"),
        )
    )


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key, without row numbers: a partial aggregate on both sides of the shuffle, which sorts as the order is a struct."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at()).alias("r")).select(*keys, "r.*")


def state_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of one state: start, end and number of samples."""
    series = Window.partitionBy(*keys).orderBy(*ORDER)
    run = F.sum("changed").over(series.rowsBetween(Window.unboundedPreceding, 0))
    return (
        with_changes(df, keys)
        .withColumn("run", run)
        .groupBy(*keys, "run", "state")
        .agg(F.min("observed_at").alias("started_at"), F.max("observed_at").alias("ended_at"), F.count("*").alias("n"))
        .drop("run")
    )


def tier(df: DataFrame, seconds: int, before: Column | None = None) -> DataFrame:
    """One storage tier: numeric and state aggregates by device, register and bucket, told apart by kind."""
    keys = ["device_id", "register_name"]
    closed = between(df, None, before)
    numbers = numeric_buckets(closed, keys, seconds).withColumn("kind", F.lit("numeric"))
    states = state_buckets(closed, keys, seconds).withColumn("kind", F.lit("state"))
    return numbers.unionByName(states, allowMissingColumns=True)


def rate_limited(df: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Rows kept when at least ``seconds`` lie between a row and the last one kept in its series.

    What is kept depends on what was kept before, so each series is folded in order; a series
    streams through its task one Arrow batch at a time.
    """
    import numpy as np
    import pyarrow as pa

    columns = df.columns
    dealt = df.withColumn("_micros", F.unix_micros(F.col("observed_at").cast("timestamp"))).repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, *ORDER)
    step = seconds * 1_000_000

    def run(batches):
        series, last = None, 0
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            kept = np.zeros(batch.num_rows, bool)
            for n, (name, now) in enumerate(zip(names, batch.column("_micros").to_pylist(), strict=True)):
                if name != series or now - last >= step:
                    kept[n], series, last = True, name, now
            yield batch.select(columns).filter(pa.array(kept))

    return dealt.mapInArrow(run, df.schema)
