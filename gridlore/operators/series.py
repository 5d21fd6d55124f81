"""Reads for charts and reports: names and scopes, headers of series, pages, joins with a dictionary, accounts.

Transforms take the columns of ``history`` where they say nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.operators.history import ORDER, at, bucket, with_changes


def clean_names(names: list[str]) -> list[str]:
    """Without blanks and repeats, in the order of their first use."""
    return list(dict.fromkeys(n.strip() for n in names if n.strip()))


def named(rows: DataFrame, names: list[str], column: str = "register_name") -> DataFrame:
    """Rows of the named registers; no name means all."""
    wanted = clean_names(names)
    return rows.where(F.col(column).isin(wanted)) if wanted else rows


def matching(rows: DataFrame, **values: object) -> DataFrame:
    """Rows that equal each value given; None asks for nothing."""
    for column, value in values.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def in_or_unset(column: Column, values: list) -> Column:
    return column.isin(values) | column.isNull()


def in_days(rows: DataFrame, first: Column, end: Column, column: str = "controller_day") -> DataFrame:
    """Days from the first up to, but without, the end."""
    return rows.where((F.col(column) >= first) & (F.col(column) < end))


#: How names of registers without a definition start.
UNNAMED = ("holding_0x", "input_0x")


def defined_only(rows: DataFrame, column: str = "register_name") -> DataFrame:
    return rows.where(~reduce(lambda a, b: a | b, (F.col(column).startswith(p) for p in UNNAMED)))


def age_ms(now: Column, then: Column) -> Column:
    """Milliseconds since then, and none for what lies ahead."""
    span = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return F.when(span < 0, 0.0).otherwise(span / 1000)


def fresh(now: Column, last_seen: Column, grace_s: float = 120.0) -> Column:
    return F.coalesce(age_ms(now, last_seen) <= grace_s * 1000, F.lit(False))


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """Start and end in UTC of a local day, which a change of clocks makes longer or shorter."""
    utc = lambda d: F.convert_timezone(F.lit(zone), F.lit("UTC"), d.cast("timestamp_ntz"))
    return utc(day), utc(F.date_add(day, 1))


def headers(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row a series: its kind, ``mixed`` where points differ, its first known unit, its size and its ends.

    The points stay rows, so that a series of any length is never gathered.
    """
    known = F.when(F.col("unit").isNotNull(), at())
    kind = F.coalesce("kind", F.lit("unknown"))
    return points.groupBy(*keys).agg(
        F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise("mixed").alias("kind"),
        F.min_by("unit", known).alias("unit"),
        F.count("*").alias("n"),
        F.min("observed_at").alias("first_at"),
        F.max("observed_at").alias("last_at"),
    )


def newest(rows: DataFrame, keys: list[str], most: int, order: list[Column]) -> DataFrame:
    """The first ``most`` rows of each key by the order, with their rank; Spark cuts each partition before it shuffles."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most)


def guarded(rows: DataFrame, most: int = 20_000) -> DataFrame:
    """The rows, or an error where a reply would have over ``most``; for the edge of an application, not between transforms."""
    if len(rows.select(F.lit(1)).take(most + 1)) > most:
        raise ValueError(f"over {most} rows; narrow the range or use a coarser window")
    return rows


def described(values: DataFrame, dictionary: DataFrame, on: list[str]) -> DataFrame:
    """Values with the columns of their dictionary entry; a unit that is not set equals an empty one.

    The dictionary has one row for each of ``on`` and unit.
    """
    entry = dictionary.withColumn("unit", F.coalesce("unit", F.lit("")))
    return values.withColumn("unit", F.coalesce("unit", F.lit(""))).join(entry, [*on, "unit"])


def day_range(days: list[DataFrame], keys: list[str]) -> DataFrame:
    """First and last day over several sources of (keys, day), each reduced before they meet."""
    ends = [d.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")) for d in days]
    both = reduce(DataFrame.unionByName, ends)
    return both.groupBy(*keys).agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def accounts(tables: dict[str, DataFrame], verified: Column, size: Column) -> DataFrame:
    """Rows, verified rows and their summed size of each table, which has the columns that both conditions read."""
    counted = [
        t.agg(
            F.count("*").alias("n"),
            F.count_if(verified).alias("n_verified"),
            F.coalesce(F.sum(F.when(verified, size)), F.lit(0)).alias("verified_size"),
        ).withColumn("table_name", F.lit(name))
        for name, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def state_sequence(rows: DataFrame, keys: list[str], series: list[str]) -> DataFrame:
    """For each of the keys (a series and, say, a day) its states in order, runs as one; the first of a key always counts."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER)) == 1
    turns = with_changes(rows, series).withColumn("first", first).where("first OR changed = 1")
    steps = F.array_sort(F.collect_list(F.struct(*ORDER, "state")))
    return turns.groupBy(*keys).agg(F.transform(steps, lambda s: s["state"]).alias("states"))


def last_of_each(observations: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """(keys, controller_id, bucket_start, value, observed_at): what each controller said last in a bucket."""
    b = bucket(F.col("observed_at"), seconds).alias("bucket_start")
    newest_first = F.struct("observed_at", "sample_id")
    return observations.groupBy(*keys, "controller_id", b).agg(
        F.max_by("value", newest_first).alias("value"), F.max("observed_at").alias("observed_at")
    )


def state_set(observations: DataFrame, keys: list[str], expected: DataFrame, on: list[str]) -> DataFrame:
    """Different states of the contributors, how many of those expected there are, and the oldest time.

    observations has one row a controller and key; ``expected`` counts controllers by ``on``.
    """
    known = observations.groupBy(*keys).agg(
        F.array_sort(F.collect_set("value")).alias("states"),
        F.countDistinct("controller_id").alias("contributors"),
        F.min("observed_at").alias("oldest_at"),
    )
    quality = F.when(F.col("contributors") >= F.coalesce("expected", F.lit(0)), "complete").otherwise("partial")
    return known.join(expected, on, "left").withColumn("quality", quality)


def eligible(controllers: DataFrame, profile_registers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(metric, controller_id) where the controller's profile has a register that the metric reads."""
    readable = profile_registers.join(aliases, "register_name").select("profile", "metric").distinct()
    return controllers.join(readable, "profile").select("metric", "controller_id")


def without(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(others.select(*on), on, "left_anti")


def system_health(controllers: DataFrame, keys: list[str]) -> DataFrame:
    """Critical with any fault, warning with an alarm or a controller that is not online, else ok.

    controllers has one row a controller: status, and whether its fault and alarm values say that all is well.
    """
    faults, alarms = F.count_if(~F.col("fault_clear")), F.count_if(~F.col("alarm_clear"))
    offline = F.count_if(F.coalesce(F.col("status"), F.lit("unknown")) != "online")
    return controllers.groupBy(*keys).agg(
        F.when(faults > 0, "critical").when((alarms > 0) | (offline > 0), "warning").otherwise("ok").alias("health"),
        faults.alias("active_faults"),
        alarms.alias("active_alarms"),
        offline.alias("offline"),
        F.count("*").alias("controllers"),
    )


def by_alias(text: Column, aliases: list[tuple[str, str, int]]) -> Column:
    """The profile whose alias stands in a text: by priority, then the longest alias, then the name.

    A fixed list becomes one expression, so texts are neither joined nor shuffled.
    """
    found = F.lit(None).cast("string")
    for alias, profile, _ in sorted(aliases, key=lambda a: (a[2], -len(a[0]), a[1]), reverse=True):
        found = F.when(text.contains(alias), profile).otherwise(found)
    return found


def longest_alias(texts: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """The same for a table of aliases (alias, profile, priority), each compared with every text."""
    said = texts.join(aliases, F.col("text").contains(F.col("alias")), "left")
    best = F.struct("priority", -F.length("alias"), "profile")
    return said.groupBy(*keys).agg(F.min_by("profile", best).alias("profile"))
