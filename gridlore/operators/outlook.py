"""Forecasts of a day's energy and of a full charge, their errors, and the energy ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.operators.history import bucket

#: Watts from which a slot of the day counts as productive.
PRODUCTIVE = 25.0


def solar_outlook(curve: DataFrame, today: DataFrame, keys: list[str], now_slot: int, hours: float = 0.25) -> DataFrame:
    """Energy so far, what the curve expected by now, and the day's end at p10, p50 and p90.

    curve has (slot, p10, p50, p90), today (slot, value), one row a slot and key.
    """
    both = curve.join(today, [*keys, "slot"], "full_outer")
    past, productive = F.col("slot") <= now_slot, F.col("p50") >= PRODUCTIVE
    total = lambda v, when: F.coalesce(F.sum(F.when(when, F.greatest(F.lit(0.0), v) * hours)), F.lit(0.0))
    observed = total(F.col("value"), past & F.col("value").isNotNull())
    ends = [F.round(observed + total(F.col(q), ~past & F.col(q).isNotNull()), 6).alias(f"end_{q}") for q in ("p10", "p50", "p90")]
    return both.groupBy(*keys).agg(
        F.round(observed, 6).alias("observed"),
        F.round(total(F.col("p50"), past & productive), 6).alias("expected"),
        *ends,
        F.round(F.try_divide(F.count_if(past & productive & F.col("value").isNotNull()), F.count_if(past & productive)), 6).alias("coverage"),
        F.count_if(productive).alias("productive_slots"),
    )


def outlook_confidence(days: Column, coverage: Column, productive_slots: Column) -> Column:
    """not_ready under five training days, else how far days and coverage carry the forecast."""
    return (
        F.when((days < 5) | (productive_slots < 1), "not_ready")
        .when((days >= 14) & (coverage >= 0.8), "high")
        .when((days >= 7) & (coverage >= 0.5), "medium")
        .otherwise("low")
    )


def error_metrics(errors: DataFrame, keys: list[str], newest: int = 14) -> DataFrame:
    """Median, mean and p90 of the percentage errors of each key's newest days."""
    late = Window.partitionBy(*keys).orderBy(F.desc("day"))
    return (
        errors.withColumn("n", F.row_number().over(late))
        .where(F.col("n") <= newest)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("days"),
            F.round(F.median("ape"), 6).alias("median_ape"),
            F.round(F.avg("ape"), 6).alias("mean_ape"),
            F.round(F.percentile("ape", 0.9), 6).alias("p90_ape"),
        )
    )


def interval_coverage(days: DataFrame, keys: list[str], newest: int = 14, least: int = 5) -> DataFrame:
    """Share of each key's newest days that lie inside their band, and whether there are enough days to say so."""
    late = Window.partitionBy(*keys).orderBy(F.desc("day"))
    chosen = days.withColumn("n", F.row_number().over(late)).where(F.col("n") <= newest)
    return chosen.groupBy(*keys).agg(
        F.count("*").alias("days"),
        F.round(F.count_if("inside") / F.count("*"), 6).alias("coverage"),
        F.when(F.count("*") >= least, "ready").otherwise("insufficient_evidence").alias("status"),
    )


def curve_energy(samples: DataFrame, keys: list[str], seconds: int = 900, least: int = 2) -> DataFrame:
    """Energy of each key and day from the means of its slots, negative ones as zero; days with too few slots are left out."""
    slots = samples.groupBy(*keys, F.to_date("observed_at").alias("day"), bucket(F.col("observed_at"), seconds).alias("slot")).agg(F.avg("numeric_value").alias("value"))
    watt_hours = F.sum(F.greatest("value", F.lit(0.0)) * (seconds / 3600))
    return slots.groupBy(*keys, "day").agg(F.count("*").alias("slots"), F.round(watt_hours, 6).alias("energy")).where(F.col("slots") >= least)


def minute_of_day(time: Column) -> Column:
    return (F.hour(time) * 60 + F.minute(time)).cast("long")


def state_days(samples: DataFrame, keys: list[str], state: str, least: int = 3) -> DataFrame:
    """(keys, day, minute): days with enough samples, and the first minute at which a state was seen, or null."""
    seen = F.min(F.when(F.col("state") == state, minute_of_day(F.col("observed_at"))))
    return samples.groupBy(*keys, F.to_date("observed_at").alias("day")).agg(F.count("*").alias("n"), seen.alias("minute")).where(F.col("n") >= least).drop("n")


def state_probability(days: DataFrame, keys: list[str]) -> DataFrame:
    """On how many of the days a state was reached, and when as a rule."""
    return days.groupBy(*keys).agg(
        F.count("*").alias("observed_days"),
        F.count("minute").alias("float_days"),
        F.round(F.count("minute") / F.count("*"), 6).alias("probability"),
        F.round(F.median("minute"), 6).alias("median_minute"),
    )


def baseline(samples: DataFrame, keys: list[str], minute: int, within: int = 45) -> DataFrame:
    """Percentiles over days of the mean within some minutes of a time of day."""
    near = F.abs(minute_of_day(F.col("observed_at")) - minute) <= within
    means = samples.where(near).groupBy(*keys, F.to_date("observed_at").alias("day")).agg(F.avg("numeric_value").alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return means.groupBy(*keys).agg(F.count("*").alias("days"), q.alias("q")).select(
        *keys, "days", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "middle", "high"))]
    )


#: What follows from the powers of a site: the formula of each value, as text and as the inputs it needs.
FLOWS = {"net": ("solar - load", ("solar", "load")), "unaccounted": ("solar - load - battery", ("solar", "load", "battery"))}


def power_flow(wide: DataFrame) -> DataFrame:
    """Adds what follows from solar, load and battery power, null where an input is missing."""
    return wide.withColumns({name: F.round(F.expr(formula), 6) for name, (formula, _) in FLOWS.items()})


def flow_payload(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, value, status, formula, missing): a row for each value, and which inputs it lacks."""
    rows = []
    for name, (formula, inputs) in FLOWS.items():
        lacks = F.filter(F.array(*[F.when(F.col(i).isNull(), i) for i in inputs]), lambda x: x.isNotNull())
        rows.append(
            F.struct(
                F.lit(name).alias("name"),
                F.round(F.expr(formula), 6).alias("value"),
                F.when(F.size(lacks) == 0, "complete").otherwise("unavailable").alias("status"),
                F.lit(formula).alias("formula"),
                F.array_join(lacks, ",").alias("missing"),
            )
        )
    return wide.select(*keys, F.inline(F.array(*rows)))


def site_charge(by_controller: DataFrame, keys: list[str]) -> DataFrame:
    """A site is charged when its slowest controller is: least probability, latest minute."""
    return by_controller.groupBy(*keys).agg(
        F.min("probability").alias("probability"), F.max("median_minute").alias("minute"), F.count("*").alias("controllers")
    )


def ledger(readings: DataFrame) -> DataFrame:
    """Watt-hours from the best counter of (system_kwh, daily_wh, daily_kwh), and which it was."""
    return readings.withColumn(
        "wh", F.coalesce(F.col("system_kwh") * 1000, F.col("daily_wh"), F.col("daily_kwh") * 1000)
    ).withColumn(
        "provenance",
        F.when(F.col("system_kwh").isNotNull(), "system_kwh")
        .when(F.col("daily_wh").isNotNull(), "daily_wh")
        .when(F.col("daily_kwh").isNotNull(), "daily_kwh")
        .otherwise("unknown"),
    )
