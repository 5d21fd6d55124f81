"""Evidence, status and the detectors that look at one controller's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlore.functions.text import state_clear


def confidence(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Weights of passed evidence less those of failed, held between 0 and 1."""
    weight = F.when(F.col("passed"), F.col("weight")).otherwise(-F.abs("weight"))
    return evidence.groupBy(*keys).agg(
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(weight))), 6).alias("confidence"), F.count("*").alias("evidence")
    )


def findings(figures: DataFrame, key: str = "controller_id") -> DataFrame:
    """One row for each detector that could be evaluated; severity is null where nothing is wrong.

    figures has a row a controller: status, terminal_v, sense_v, input_w, output_w, fault, alarm,
    polls, success_rate, miss_rate, state_samples, absorptions, days, coverage_percent, solar_w,
    solar_median, solar_low.  All detectors read that row, so nothing is shuffled.
    """
    c = F.col
    gap = F.abs(c("terminal_v") - c("sense_v"))
    ratio = F.try_divide(c("output_w"), c("input_w"))
    median = c("solar_median")
    trigger = F.least(0.60 * median, 0.75 * F.coalesce(F.nullif(c("solar_low"), F.lit(0.0)), median))
    level = lambda fires, critical: F.when(fires & critical, "critical").when(fires, "warning")
    plain = lambda name: state_clear(F.lit(None).cast("double"), c(name))
    never, always = F.lit(False), F.lit(True)
    found = {
        "controller_offline": (always, level(~c("status").eqNullSafe("online"), never)),
        "battery_sense_divergence": (gap.isNotNull(), level(gap >= 0.25, gap >= 0.50)),
        "controller_efficiency": (c("output_w").isNotNull() & (c("input_w") >= 100), level(ratio < 0.80, ratio < 0.60)),
        "controller_fault": (c("fault").isNotNull(), level(~plain("fault"), always)),
        "controller_alarm": (c("alarm").isNotNull(), level(~plain("alarm"), never)),
        "polling_degradation": (c("polls") >= 20, level((c("success_rate") < 0.95) | (c("miss_rate") > 0.10), c("success_rate") < 0.80)),
        "charge_stage_cycling": (c("state_samples") >= 3, level(c("absorptions") >= 6, c("absorptions") >= 10)),
        "history_coverage": (c("days") >= 3, level(c("coverage_percent") < 80, never)),
        "solar_underproduction": (c("solar_w").isNotNull() & (median >= 100), level(c("solar_w") < trigger, c("solar_w") < 0.25 * median)),
    }
    rows = [F.struct(F.lit(n).alias("detector"), F.coalesce(e, never).alias("evaluated"), s.alias("severity")) for n, (e, s) in found.items()]
    return figures.select(key, F.inline(F.array(*rows))).where("evaluated").drop("evaluated")
