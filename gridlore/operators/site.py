"""Site views: alias choice, aggregation over controllers, consensus, curves, findings and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def pick_alias(values: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and metric, the value of the first alias that has one."""
    found = values.join(aliases, "register_name").where("value is not null")
    return found.groupBy(*keys, "metric").agg(F.min_by("value", F.struct("priority", "register_name")).alias("value"))


def over_controllers(picked: DataFrame, keys: list[str], expected: Column) -> DataFrame:
    """Sum, median, extremes and contributors of each metric, with a quality label."""
    n = F.count("value")
    return picked.groupBy(*keys, "metric").agg(
        n.alias("contributors"),
        F.round(F.sum("value"), 6).alias("total"),
        F.round(F.median("value"), 6).alias("middle"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.when(n == 0, "empty").when((F.max(expected) == 0) | (n >= F.max(expected)), "complete").otherwise("partial").alias("quality"),
    )


def consensus(reports: DataFrame, keys: list[str], absolute: float, relative: float) -> DataFrame:
    """One value where the sources agree within the tolerance, else a conflict and no value."""
    spread = F.max("value") - F.min("value")
    middle = F.median("value")
    agree = (F.count("value") == 1) | (spread <= F.greatest(F.lit(absolute), relative * F.abs(middle)))
    return reports.where("value is not null").groupBy(*keys).agg(
        F.count("value").alias("sources"),
        F.round(spread, 6).alias("spread"),
        F.when(F.count("value") == 1, "single").when(agree, "agreed").otherwise("conflict").alias("resolution"),
        F.when(agree, F.round(middle, 6)).alias("value"),
    )


def slot_curve(points: DataFrame, minutes: int = 15) -> DataFrame:
    """Percentiles of the values in each slot of the day, over all training days."""
    minute = F.hour("observed_at") * 60 + F.minute("observed_at")
    slot = (minute - minute % minutes).cast("long")
    q = F.percentile("numeric_value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return points.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), q.alias("q")).select(
        "slot",
        "n",
        *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("p10", "p50", "p90"))],
    )


def walk_forward(daily: DataFrame, keys: list[str], days: int = 28, least: int = 5) -> DataFrame:
    """Each day against the median of the rows before it; days with too short a past are left out."""
    past = Window.partitionBy(*keys).orderBy("day").rowsBetween(-days, -1)
    median = lambda c: F.expr(
        f"(element_at({c}, CAST((size({c}) + 1) div 2 AS INT)) + element_at({c}, CAST(size({c}) div 2 + 1 AS INT))) / 2"
    )
    return (
        daily.withColumn("past", F.array_sort(F.collect_list("energy").over(past)))
        .where(F.size("past") >= least)
        .withColumn("forecast", median("past"))
        .where("energy > 0")
        .withColumn("ape", F.abs(F.col("forecast") - F.col("energy")) / F.col("energy") * 100)
    )


def walk_forward_bands(daily: DataFrame, keys: list[str], days: int = 28, least: int = 5) -> DataFrame:
    """Each day against the tenth and ninetieth percentile of the rows before it: low, high, and whether it lies between.

    A day's past is an array of ``days`` values at the most, whatever the length of the series; its percentiles lie between ranks.
    """
    past = Window.partitionBy(*keys).orderBy("day").rowsBetween(-days, -1)

    def quantile(q: float) -> Column:
        place = (F.size("past") - 1) * F.lit(q)
        at = lambda n: F.element_at("past", n.cast("int") + 1)
        return at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * (place - F.floor(place))

    return (
        daily.withColumn("past", F.array_sort(F.collect_list("energy").over(past)))
        .where(F.size("past") >= least)
        .withColumns({"low": quantile(0.1), "high": quantile(0.9)})
        .withColumn("inside", F.col("energy").between(F.col("low"), F.col("high")))
        .drop("past")
    )


def durations(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Seconds in each state, credited to the earlier of two samples unless they are too far apart; and entries."""
    series = Window.partitionBy(*keys).orderBy("observed_at", "sample_id")
    seconds = F.unix_seconds(F.col("observed_at").cast("timestamp"))
    after = F.lead(seconds).over(series) - seconds
    before = F.lag("state").over(series)
    return (
        df.select(*keys, "state", after.alias("after"), (before.isNull() | (before != F.col("state"))).alias("entry"))
        .groupBy(*keys, "state")
        .agg(
            F.sum(F.when(F.col("after").between(0, cap), F.col("after")).otherwise(0)).alias("seconds"),
            F.count_if("entry").alias("entries"),
        )
    )


#: States whose coming is counted, and how far apart samples may be.
ENTRIES = {"ABSORPTION": "absorption_entries", "FLOAT": "float_entries"}
NEAR_S = 900


def charge_cycle(samples: DataFrame, keys: list[str], now: Column, hours: int = 24, cap_s: float = NEAR_S) -> DataFrame:
    """The charge states of each key in the hours before now: samples, transitions, entries, the sequence, and seconds by state.

    States are trimmed and in upper case; blank ones count as samples and nothing else.  Time to the next state is credited unless it
    is over the cap.  Sequences and maps are bounded by the samples of the period.
    """
    at = F.col("observed_at").cast("timestamp")
    state = F.upper(F.trim(F.coalesce("state", F.lit(""))))
    rows = samples.where((at >= now.cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))) & (at < now.cast("timestamp"))).withColumn("state", state)
    series = Window.partitionBy(*keys).orderBy("observed_at", "sample_id")
    after = (F.lead(F.unix_micros(at)).over(series) - F.unix_micros(at)) / 1e6
    before = F.lag("state").over(series)
    told = rows.where("state <> ''").select(
        *keys, "observed_at", "sample_id", "state", after.alias("after"), (before.isNull() | (before != F.col("state"))).alias("entry")
    )
    step = F.when(F.col("entry"), F.struct("observed_at", "sample_id", "state"))
    by_state = told.groupBy(*keys, "state").agg(
        F.round(F.sum(F.when(F.col("after") <= cap_s, F.col("after")).otherwise(0.0)), 6).alias("seconds"),
        F.count_if("entry").alias("entries"),
        F.collect_list(step).alias("steps"),
    )
    entered = [F.coalesce(F.sum(F.when(F.col("state") == s, F.col("entries"))), F.lit(0)).alias(n) for s, n in ENTRIES.items()]
    whole = by_state.groupBy(*keys).agg(
        (F.sum("entries") - 1).alias("transition_count"),
        *entered,
        F.transform(F.array_sort(F.flatten(F.collect_list("steps"))), lambda x: x["state"]).alias("stage_sequence"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "seconds")))).alias("seconds_by_state"),
    )
    counted = rows.groupBy(*keys).agg(F.count("*").alias("observed_samples"))
    return counted.join(whole, keys, "left").na.fill(0, ["transition_count", *ENTRIES.values()])


#: Columns of a finding whose change makes an update; null and empty are the same.
TOLD = ("severity", "confidence", "title", "summary")


def reconcile(active: DataFrame, findings: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Next state of every incident: opened, updated, unchanged, resolved, or kept where it was not evaluated.

    active and findings have (fingerprint, evaluation_key, severity) and may have confidence, title
    and summary; active may have occurrence_count; evaluated has evaluation_key.  What is found
    again counts once more, updated or not.
    """
    told = [c for c in TOLD if c in active.columns and c in findings.columns]
    count = F.col("occurrence_count") if "occurrence_count" in active.columns else F.lit(1)
    side = lambda df, age, *more: df.select(
        "fingerprint", F.col("evaluation_key").alias(f"{age}_key"), F.struct(*told).alias(age), *more
    )
    old = side(active, "old", count.cast("long").alias("times"))
    both = old.join(side(findings, "new"), "fingerprint", "full_outer").withColumn("evaluation_key", F.coalesce("new_key", "old_key"))
    seen = evaluated.select("evaluation_key").distinct().withColumn("seen", F.lit(True))
    plain = lambda age, c: F.coalesce(F.col(f"{age}.{c}").cast("string"), F.lit(""))
    changed = F.lit(False)
    for c in told:
        changed = changed | (plain("old", c) != plain("new", c))
    again = F.col("new_key").isNotNull()
    action = (
        F.when(F.col("old_key").isNull(), "opened")
        .when(again & changed, "updated")
        .when(again, "unchanged")
        .when(F.col("seen"), "resolved")
        .otherwise("kept")
    )
    return both.join(seen, "evaluation_key", "left").select(
        "fingerprint",
        "evaluation_key",
        action.alias("action"),
        F.coalesce("new.severity", "old.severity").alias("severity"),
        (F.coalesce("times", F.lit(0)) + again.cast("long")).alias("occurrences"),
    )


#: What a finding of a severity costs its category, and the categories.
COST = {"info": 2, "warning": 8, "critical": 20}
CATEGORIES = ("production", "charging", "battery", "communications", "data_integrity")


def health_score(findings: DataFrame, keys: list[str], subjects: DataFrame | None = None) -> DataFrame:
    """Five categories of 20 points each, less what their findings cost; other categories cost nothing.

    A finding without a category is one of data integrity.  subjects has all keys to score:
    those without a finding have 100 points.
    """
    cost = F.lit(COST["info"])
    for severity, points in COST.items():
        cost = F.when(F.col("severity") == severity, points).otherwise(cost)
    category = F.when(F.coalesce("category", F.lit("")) == "", "data_integrity").otherwise(F.col("category"))
    lost = (
        findings.withColumn("category", category)
        .groupBy(*keys, "category")
        .agg(F.least(F.lit(20), F.sum(cost)).alias("points"), F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(F.sum(F.when(F.col("category").isin(*CATEGORIES), F.col("points")).otherwise(0)).alias("lost"), F.sum("n").alias("n"))
    )
    every = lost if subjects is None else subjects.select(*keys).distinct().join(lost, keys, "left")
    score = (F.lit(100) - F.coalesce("lost", F.lit(0))).cast("long")
    return every.select(
        *keys,
        score.alias("score"),
        F.when(score >= 85, "good").when(score >= 60, "warning").otherwise("critical").alias("status"),
        F.coalesce("n", F.lit(0)).cast("long").alias("active_incidents"),
    )


def poll_summary(polls: DataFrame, keys: list[str]) -> DataFrame:
    seconds = F.unix_seconds(F.col("observed_at").cast("timestamp"))
    span = F.max(seconds) - F.min(seconds)
    q = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return (
        polls.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.round(F.count_if("success") / F.count("*"), 6).alias("success_rate"),
            F.round(F.coalesce(F.try_divide(F.count("*") - 1, span), F.lit(0.0)), 9).alias("poll_rate"),
            F.round(F.coalesce(F.try_divide(F.sum("request_count"), span), F.lit(0.0)), 9).alias("request_rate"),
            q.alias("q"),
            F.round(F.avg("bus_percent"), 6).alias("bus_mean"),
            F.round(F.max("bus_percent"), 6).alias("bus_max"),
        )
        .select("*", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])
        .drop("q")
    )


def stage_verdicts(stages: DataFrame) -> DataFrame:
    """Which intervals pass all thresholds, and whether all slower ones pass too.

    stages has (device_id, interval_s, success_rate, p95, miss_rate, bus_max); latencies in ms.
    """
    checks = (
        (F.col("success_rate") < 0.98, "success"),
        (F.col("p95") > 0.80 * 1000 * F.col("interval_s"), "latency"),
        (F.col("miss_rate") > 0.05, "deadline"),
        (F.col("bus_max") > 70, "bus"),
    )
    reasons = F.concat_ws(",", *[F.when(c, F.lit(n)) for c, n in checks])
    slower = Window.partitionBy("device_id").orderBy(F.desc("interval_s")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        stages.withColumn("reasons", reasons)
        .withColumn("passed", F.col("reasons") == "")
        .withColumn("usable", F.min("passed").over(slower))
    )


def derived_power(values: DataFrame) -> DataFrame:
    """Reported input power, or output power where the two disagree: power, source, quality and note.

    values has (input_power, output_power, volts, amps); volts times amps stand in for a missing
    output power.  Where nothing is reported all four are null.
    """
    reference = F.coalesce("output_power", F.col("volts") * F.col("amps"))
    reported = F.col("input_power")
    suspect = F.when(reference < 25, reported > 250).otherwise(
        (reported > F.greatest(2 * reference, reference + 250)) | (reported < 0.5 * reference)
    )
    proxy = F.coalesce(suspect, F.lit(False))
    either = lambda yes, no: F.when(reported.isNotNull(), F.when(proxy, yes).otherwise(no))
    told = lambda watts: F.format_string("%.2f W", watts.cast("double"))
    origin = F.when(F.col("output_power").isNotNull(), "output power").otherwise("voltage times current")
    return values.withColumns(
        {
            "power": either(reference, reported),
            "source": either(F.lit("charge_output_proxy"), F.lit("controller_reported")),
            "quality": either(F.lit("estimated_from_output"), F.lit("reported_unverified")),
            "note": either(  # fixed values: the labels of source and quality above
                F.concat(F.lit("reported "), told(reported), F.lit(" against "), told(reference), F.lit(" by "), origin),
                F.lit("the current behind the reported power is no precision measurement"),
            ),
        }
    )


#: Plausible range of a unit.
ENVELOPE = {"V": (-1.0, 1000.0), "A": (-1000.0, 1000.0), "C": (-80.0, 180.0), "%": (-1.0, 101.0), "Hz": (0.0, 1000.0)}


def plausibility(values: DataFrame) -> DataFrame:
    """Verdict on (value, unit): plausible, implausible, non_finite or unknown_unit."""
    v, unit = F.col("value"), F.col("unit")
    out = F.when(v.isNull(), "missing").when(F.isnan(v) | (F.abs(v) == float("inf")), "non_finite")
    for name, (low, high) in ENVELOPE.items():
        out = out.when(unit == name, F.when(v.between(low, high), "plausible").otherwise("implausible"))
    return values.withColumn("verdict", out.otherwise("unknown_unit"))
