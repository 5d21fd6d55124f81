"""Storage upkeep: tiers, state runs and an archive, rebuilt only for the days that have changed.

Raw rows (sample_id, device_id, observed_at, register_name, numeric_value, state) lie under ``raw``, one folder a day.  A run looks at the
raw days that are old enough for an artifact, compares each with what the artifact's ledger says of it, and rebuilds
those that differ, by overwriting just their folders.  The ledger is written last: a run that stops before has
no entry, and the next one repeats the same days without doubling anything.  Rows that come late for a day
that has been pruned are joined with its archived rows first, so what is rebuilt is always the whole day.

Days do not depend on each other: buckets do not cross midnight, runs are cut there (``joined_runs`` joins them), and a tier counts the
changes within a bucket, to which ``tier_rows`` adds those between a bucket and the one before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridlore.operators import history
from gridlore.sources import archive
from gridlore.sources.shared import materialise

SERIES = ["device_id", "register_name"]
ROW = "sample_id long, device_id long, observed_at timestamp_ntz, register_name string, numeric_value double, state string"
LEDGER = "artifact string, day date, n long, digest decimal(38,0), run string, at long"
#: Days after which a day goes to a tier, and the tier's seconds.
TIERS = {"warm": (7, 10), "cool": (30, 60), "cold": (180, 300)}
RUNS, ARCHIVE = "runs", "archive"


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What lies under path, or no rows where nothing does yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def bucket_tier(rows: DataFrame, seconds: int) -> DataFrame:
    """Aggregates of each bucket on its own; changes are those within the bucket."""
    keys = [*SERIES, "bucket_start"]
    placed = rows.withColumn("bucket_start", history.bucket(F.col("observed_at"), seconds))
    numbers = history.numeric_buckets(rows, SERIES, seconds).withColumn("kind", F.lit("numeric"))
    states = history.state_stats(placed, keys).drop("first_at", "last_at").withColumn("kind", F.lit("state"))
    return numbers.unionByName(states, allowMissingColumns=True).withColumn("day", F.to_date(F.timestamp_seconds("bucket_start")))


def day_runs(rows: DataFrame) -> DataFrame:
    """Maximal runs of one state, cut at midnight."""
    return history.state_runs(rows.withColumn("day", F.to_date("observed_at")), [*SERIES, "day"])


def builders(tiers: dict[str, tuple[int, int]]) -> dict[str, tuple[int, Callable[[DataFrame], DataFrame]]]:
    first = min(days for days, _ in tiers.values())
    made = {name: (days, lambda rows, s=seconds: bucket_tier(rows, s)) for name, (days, seconds) in tiers.items()}
    return made | {RUNS: (first, day_runs), ARCHIVE: (first, lambda rows: rows.withColumn("day", F.to_date("observed_at")))}


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The last entry of each artifact and day."""
    rows = read_or_none(spark, f"{root}/ledger", LEDGER)
    return rows.groupBy("artifact", "day").agg(F.max_by(F.struct("n", "digest", "run"), F.struct("at", "run")).alias("e")).select("artifact", "day", "e.*")


def raw_days(spark: SparkSession, root: str) -> DataFrame:
    return archive.manifest(read_or_none(spark, f"{root}/raw", f"{ROW}, day date")).select("day", "n", F.col("digest").cast("decimal(38,0)").alias("digest"))


def append_raw(rows: DataFrame, root: str) -> None:
    rows.withColumn("day", F.to_date("observed_at")).write.mode("append").partitionBy("day").parquet(f"{root}/raw")


def maintain(spark: SparkSession, root: str, today: date, tiers: dict[str, tuple[int, int]] = TIERS, prune: bool = True, files_a_day: int = 8) -> DataFrame:
    """One run; returns (artifact, day, n, digest, run) of what it rebuilt, without rows where nothing had changed.

    ``today`` is the first day that is not over.  A day of an artifact is dealt to files_a_day tasks by device.  Pruned are raw days that are archived: the archive is read back and must have
    the rows and the digest of what was to be written.
    """
    plans = builders(tiers)
    limits = sorted(days for days, _ in plans.values())
    if limits[0] < 1:
        raise ValueError("a day must be over before it goes to a tier")
    run = uuid.uuid4().hex
    now = raw_days(spark, root)
    done = ledger(spark, root)
    due = [now.where(F.col("day") < F.lit(today - timedelta(days=days))).withColumn("artifact", F.lit(name)) for name, (days, _) in plans.items()]
    wanted = due[0]
    for more in due[1:]:
        wanted = wanted.unionByName(more)
    known = done.select("artifact", "day", F.col("n").alias("had"), F.col("digest").alias("was"))
    touched = materialise(
        wanted.join(known, ["artifact", "day"], "left").where("had is null or n <> had or digest <> was").select("artifact", "day", "n", "digest")
    )
    days = sorted({r.day for r in touched.select("day").distinct().collect()})  # folders, a row a day
    if days:
        here = F.col("day").isin(days)
        raw = read_or_none(spark, f"{root}/raw", f"{ROW}, day date").where(here)
        old = read_or_none(spark, f"{root}/{ARCHIVE}", f"{ROW}, day date").where(here)
        rows = materialise(raw.unionByName(old).dropDuplicates(["device_id", "register_name", "observed_at", "sample_id"]))
        for name, (_, build) in plans.items():
            own = rows.join(touched.where(F.col("artifact") == name).select("day"), "day", "left_semi").drop("day")
            (
                build(own)
                .repartition("day", F.pmod(F.xxhash64("device_id"), F.lit(files_a_day)))
                .sortWithinPartitions("day", "device_id")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .option("compression", "zstd")
                .partitionBy("day")
                .parquet(f"{root}/{name}")
            )
        entries = touched.withColumn("run", F.lit(run)).withColumn("at", F.unix_micros(F.current_timestamp()))
        meant = archive.manifest(rows).select("day", "n", "digest")
        kept = archive.manifest(read_or_none(spark, f"{root}/{ARCHIVE}", f"{ROW}, day date").where(here)).select("day", F.col("n").alias("m"), F.col("digest").alias("d"))
        archived = touched.where(F.col("artifact") == ARCHIVE).select("day")
        torn = meant.join(archived, "day", "left_semi").join(kept, "day", "left").where("m is null or n <> m or digest <> d")
        if torn.take(1):
            raise OSError("the archive does not hold what was written to it")
        entries.write.mode("append").parquet(f"{root}/ledger")
    if prune:
        for r in raw_days(spark, root).join(ledger(spark, root).where(F.col("artifact") == ARCHIVE), ["day", "n", "digest"], "left_semi").select("day").collect():
            later = [name for name, (age, _) in plans.items() if r.day >= today - timedelta(days=age)]
            if not later:
                delete(spark, f"{root}/raw/day={r.day.isoformat()}")
    return touched.withColumn("run", F.lit(run))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def tier_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A tier as a whole: transitions include the change from the bucket before."""
    rows = spark.read.parquet(f"{root}/{name}").drop("day")
    series = Window.partitionBy(*SERIES, "kind").orderBy("bucket_start")
    before = F.lag("last_state").over(series)
    crossed = (before.isNotNull() & (before != F.col("first_state"))).cast("long")
    return rows.withColumn("transitions", F.col("transitions") + crossed)


def joined_runs(spark: SparkSession, root: str) -> DataFrame:
    """State runs over midnight: a day's first run goes on the one before it in its series if both have one state."""
    rows = spark.read.parquet(f"{root}/{RUNS}").drop("day")
    series = Window.partitionBy(*SERIES).orderBy("started_at", "ended_at")
    before = F.lag("state").over(series)
    new = F.when(before.isNull() | (before != F.col("state")), 1).otherwise(0)
    run = F.sum("new").over(series.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("new", new)
        .withColumn("run", run)
        .groupBy(*SERIES, "run", "state")
        .agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.sum("n").alias("n"))
        .drop("run")
    )
