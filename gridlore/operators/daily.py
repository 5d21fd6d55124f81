"""Days: live counts, retained records, coverage, gaps, trapezoid energy and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.operators.history import ORDER, order_key


def live_days(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.to_date("observed_at").alias("day")).agg(F.count("*").alias("live"))


def newest_records(records: DataFrame, keys: list[str]) -> DataFrame:
    """One record for each key and day: the last retrieved, by record id among equals."""
    rest = [c for c in records.columns if c not in (*keys, "controller_day")]
    newest = F.max_by(F.struct(*rest), F.struct("retrieved_at", "record_id"))
    return records.groupBy(*keys, "controller_day").agg(newest.alias("r")).select(*keys, "controller_day", "r.*")


def day_states(live: DataFrame, records: DataFrame, keys: list[str], start: Column, days: int) -> DataFrame:
    """A row for each key and day of the period: live, recovered, partial or missing.

    live has (keys, day, live), rows of a day are added up; records as newest_records takes them.  Both are read once and meet in one aggregate by
    day; a second one, by key, holds the days of the period that say anything, and the other days are made within its row.  All that
    follows by key needs no shuffle.
    """
    as_long = lambda c: F.col(c).cast("long")
    place = order_key(records, "retrieved_at", "record_id")
    told = live.select(*keys, "day", as_long("live").alias("live")).unionByName(
        records.select(*keys, F.col("controller_day").alias("day"), "is_complete", "charge_wh", place.alias("place")), allowMissingColumns=True
    )
    by_day = told.groupBy(*keys, "day").agg(
        F.coalesce(F.sum("live"), F.lit(0)).alias("live"), F.max_by("is_complete", "place").alias("is_complete"), F.max_by("charge_wh", "place").alias("charge_wh")
    )
    inside = (F.col("day") >= start) & (F.col("day") < F.date_add(start, days))
    entry = F.struct(F.col("day"), F.struct("live", "is_complete", "charge_wh").alias("d"))
    by_key = by_day.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(inside, entry))).alias("told"))
    spine = by_key.select(*keys, "told", F.explode(F.sequence(start, F.date_add(start, days - 1))).alias("day"))
    d = F.try_element_at("told", "day")
    live_n, complete = F.coalesce(d["live"], F.lit(0).cast("long")), d["is_complete"]
    state = F.when(live_n > 0, "live").when(complete, "recovered").when(complete.isNotNull(), "partial").otherwise("missing")
    return spine.select(*keys, "day", live_n.alias("live"), d["charge_wh"].alias("charge_wh"), complete.alias("is_complete"), state.alias("status"))


def coverage(states: DataFrame, keys: list[str]) -> DataFrame:
    covered = F.count_if((F.col("live") > 0) | F.coalesce("is_complete", F.lit(False)))
    return states.groupBy(*keys).agg(
        F.count("*").alias("days"),
        F.count_if(F.col("live") > 0).alias("live_days"),
        F.count_if(F.col("status") == "recovered").alias("recovered_days"),
        covered.alias("covered_days"),
        (F.count("*") - covered).alias("missing_days"),
        F.round(covered * 100.0 / F.count("*"), 2).alias("covered_percent"),
    )


def gaps(states: DataFrame, keys: list[str]) -> DataFrame:
    """Adjacent days without live samples and with the same label, merged; to_day is exclusive."""
    by_label = Window.partitionBy(*keys, "status").orderBy("day")
    return (
        states.where("status <> 'live'")
        .withColumn("island", F.date_sub("day", F.row_number().over(by_label)))
        .groupBy(*keys, "status", "island")
        .agg(F.min("day").alias("from_day"), F.date_add(F.max("day"), 1).alias("to_day"), F.count("*").alias("days"))
        .drop("island")
    )


def energy(df: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """Trapezoids between neighbouring samples of one UTC day; wider gaps are skipped and counted."""
    series = Window.partitionBy(*keys, "day").orderBy(*ORDER)
    micros = F.unix_micros(F.col("observed_at").cast("timestamp"))
    rows = df.where("numeric_value is not null").withColumn("day", F.to_date("observed_at")).withColumn("micros", micros)
    paired = rows.withColumn("dt", (F.col("micros") - F.lag("micros").over(series)) / 1e6).withColumn(
        "pair", F.col("numeric_value") + F.lag("numeric_value").over(series)
    )
    near, far = (F.col("dt") > 0) & (F.col("dt") <= max_gap), F.col("dt") > max_gap
    return paired.groupBy(*keys, "day").agg(
        F.count("*").alias("n"),
        F.when(
            F.count("*") >= 2, F.round(F.sum(F.when(near, F.col("pair") / 2 * F.col("dt") / 3600).otherwise(0.0)), 3)
        ).alias("wh"),
        F.round(F.sum(F.when(near, F.col("dt")).otherwise(0.0)), 3).alias("integrated_s"),
        F.round(F.sum(F.when(far, F.col("dt")).otherwise(0.0)), 3).alias("skipped_s"),
    )


def compare_energy(local: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Integrated against recorded energy by day."""
    own = newest_records(records, keys).select(*keys, F.col("controller_day").alias("day"), "charge_wh")
    both = local.join(own, [*keys, "day"], "full_outer")
    gap = F.round(F.col("wh") - F.col("charge_wh"), 3)
    return both.select(
        *keys,
        "day",
        "wh",
        "charge_wh",
        gap.alias("difference_wh"),
        F.when(F.col("charge_wh") != 0, F.round(gap / F.col("charge_wh") * 100, 2)).alias("difference_percent"),
    )
