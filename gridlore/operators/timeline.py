"""What a site is made of and what happened there: topology, metric history, points of series, events of four sources in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.functions.text import charge_event, state_clear
from gridlore.operators.history import bucket


# topology


def topology(members: DataFrame, identities: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, bridges) of each site.

    members has (system_id, controller_uid, controller_id), identities (controller_id, profile, family, model), connections (controller_id, transport, target, port,
    unit_id, active, last_seen).  Controllers without an identity or a connection are nodes too.  A network endpoint is
    named by target and port, another by its target.  An active network endpoint that several controllers of a site share
    may be a bridge: its controllers are rows, not a list, so an endpoint of any size stays small rows.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    known = members.join(identities, "controller_id", "left")
    controllers = known.select("system_id", F.col("controller_uid").alias("node_id"), F.lit("controller").alias("kind"), blank("profile"), blank("family"), blank("model"))
    network = F.col("transport") == "tcp"
    port = F.coalesce(F.col("port"), F.lit(0))
    endpoint = F.concat_ws(":", "transport", "target", F.when(network, port))
    linked = members.join(connections, "controller_id").withColumn("endpoint_id", endpoint)
    none = F.lit("")
    endpoints = linked.select("system_id", F.col("endpoint_id").alias("node_id"), F.lit("transport_endpoint").alias("kind"), none.alias("profile"), none.alias("family"), none.alias("model"))
    links = linked.select("system_id", F.col("controller_uid").alias("source"), F.col("endpoint_id").alias("target"), "unit_id", "active", "last_seen")
    live = linked.where(network & F.col("active")).select("system_id", "target", port.alias("port"), "controller_uid", "unit_id")
    place = ["system_id", "target", "port"]
    shared = live.groupBy(*place).agg(F.min("controller_uid").alias("low"), F.max("controller_uid").alias("high")).where("low <> high").drop("low", "high")
    return controllers.unionByName(endpoints).distinct(), links, live.join(shared, place)


# metric history by observation

AGGREGATES = {
    "sum": lambda v, _: F.sum(v),
    "median": lambda v, _: F.median(v),
    "max": lambda v, _: F.max(v),
    "min": lambda v, _: F.min(v),
    "latest": lambda v, at: F.max_by(v, at),
}


def one_alias(observations: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, controller_id, observed_at, value): of what a controller said at one time under several names, the name of
    least priority, the first sample among equals.

    observations has (keys, controller_id, sample_id, observed_at, register_name, value), aliases (metric, register_name, priority).
    """
    said = observations.join(aliases, "register_name")
    return said.groupBy(*keys, "metric", "controller_id", "observed_at").agg(F.min_by("value", F.struct("priority", "sample_id")).alias("value"))


def metric_history(chosen: DataFrame, keys: list[str], seconds: int, how: dict[str, str], expected: DataFrame, on: list[str], now: Column) -> DataFrame:
    """A row for each bucket of a metric: its value over the last observation of each controller, and how whole that is.

    ``how`` names the aggregate of each metric (see AGGREGATES); ``expected`` counts controllers by ``on``.  A controller without
    a number contributes, but not to the value.  Of observations at one time the greatest controller is the latest.
    """
    start = bucket(F.col("observed_at"), seconds).alias("bucket_start")
    last = chosen.groupBy(*keys, "metric", "controller_id", start).agg(F.max_by("value", "observed_at").alias("value"), F.max("observed_at").alias("observed_at"))
    value = F.lit(None).cast("double")
    at = F.when(F.col("value").isNotNull(), F.struct("observed_at", "controller_id"))
    for metric, name in how.items():
        value = F.when(F.col("metric") == metric, AGGREGATES[name](F.col("value"), at).cast("double")).otherwise(value)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.min("observed_at").cast("timestamp"))) / 1000
    found = last.groupBy(*keys, "metric", "bucket_start").agg(value.alias("value"), F.count("*").alias("contributors"), F.greatest(F.lit(0.0), age).alias("oldest_age_ms"))
    wanted = F.coalesce("expected", F.lit(0))
    return found.join(expected, on, "left").withColumn("quality", F.when((wanted == 0) | (F.col("contributors") >= wanted), "complete").otherwise("partial"))


# points of series


def points(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], most: int = 20_000) -> DataFrame:
    """(keys, part, n, points): the rows of each series as arrays in order, ``most`` in a part at the most, parts from 0.

    Ranks come from a window over the series, as its order does; no array grows with the series.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    cut = rows.withColumn("place", place).withColumn("part", F.floor(F.col("place") / most).cast("long"))
    inner = F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("p")))), lambda x: x["p"])
    return cut.groupBy(*keys, "part").agg(F.count("*").alias("n"), inner.alias("points"))


def by_name(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, values): a map from each register's name to its value in a sample; of a name that stands several times the last by address.

    A sample has as many registers as its device, so the map is bounded by the catalog.
    """
    once = values.groupBy(*keys, "register_name").agg(F.max_by("value", "address").alias("value"))
    return once.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("register_name", "value")))).alias("values"))


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, values): the different values of each key in the order of their first use."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


# events

#: Registers whose changes are events.
WATCHED = ("charge_state", "charger_state", "faults", "fault_state", "alarms", "alarm_state")
EVENT = ("event_id", "controller_uid", "observed_at", "event_type", "severity", "source", "message", "detail")


def transitions(values: DataFrame) -> DataFrame:
    """Events from changes of (controller_uid, sample_id, observed_at, register_name, numeric_value, text_value); a number goes before a text.

    Nothing is told of what follows on an unknown value.
    """
    series = Window.partitionBy("controller_uid", "register_name").orderBy("observed_at", "sample_id")
    number, text = F.col("numeric_value"), F.when(F.col("numeric_value").isNull(), F.col("text_value"))
    was_number, was_text = F.lag(number).over(series), F.lag(text).over(series)
    shown = lambda n, t: F.coalesce(n.cast("string"), t)
    rows = (
        values.where(F.col("register_name").isin(*WATCHED))
        .withColumn("text", text)
        .withColumn("old_number", was_number)
        .withColumn("old_text", was_text)
        .where("(old_number is not null or old_text is not null) and not (old_number <=> numeric_value and old_text <=> text)")
    )
    name = F.lower("register_name")
    clear = state_clear(F.col("numeric_value"), F.col("text"))
    started = lambda what: F.when(clear, f"{what}_CLEARED").otherwise(f"{what}_STARTED")
    charge, fault, alarm = (name.contains(w) for w in ("charge", "fault", "alarm"))
    kind = F.when(charge, charge_event(shown(F.col("numeric_value"), F.col("text")))).when(fault, started("FAULT")).when(alarm, started("ALARM")).otherwise("STATE_CHANGED")
    severity = F.when(charge | clear, "info").when(fault, "critical").when(alarm, "warning").otherwise("info")
    return rows.select(
        F.concat_ws(":", F.lit("transition"), "controller_uid", "sample_id", "register_name").alias("event_id"),
        "controller_uid",
        "observed_at",
        kind.alias("event_type"),
        severity.alias("severity"),
        F.lit("live").alias("source"),
        F.lit("").alias("message"),
        F.concat_ws(" > ", shown(F.col("old_number"), F.col("old_text")), shown(F.col("numeric_value"), F.col("text"))).alias("detail"),
    )


def poll_errors(errors: DataFrame) -> DataFrame:
    """Events from (error_id, controller_uid, device_id, observed_at, error)."""
    return errors.select(
        F.concat(F.lit("poll-error:"), "error_id").alias("event_id"),
        "controller_uid",
        "observed_at",
        F.lit("COMMUNICATION_ERROR").alias("event_type"),
        F.lit("warning").alias("severity"),
        F.lit("poll").alias("source"),
        F.col("error").alias("message"),
        F.col("device_id").cast("string").alias("detail"),
    )


def syncs(runs: DataFrame) -> DataFrame:
    """Events from backfills: (sync_id, controller_uid, attempted_at, source, status, records_seen, records_written, error)."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return runs.select(
        F.concat(F.lit("history-sync:"), "sync_id").alias("event_id"),
        "controller_uid",
        F.col("attempted_at").alias("observed_at"),
        F.when(ok, "HISTORY_BACKFILL_COMPLETED").otherwise("HISTORY_BACKFILL_FAILED").alias("event_type"),
        F.when(ok, "info").otherwise("warning").alias("severity"),
        "source",
        F.coalesce("error", F.lit("")).alias("message"),
        F.concat_ws(" of ", F.col("records_written").cast("string"), F.col("records_seen").cast("string")).alias("detail"),
    )


def timeline(sources: list[DataFrame], members: DataFrame, most: int = 500, default_system: object = None) -> DataFrame:
    """(system_id, place, event...): the newest events of each site over all sources, the greatest id first among equal times.

    sources have the columns of EVENT, members (system_id, controller_uid).  Events without a controller belong to the default site,
    if there is one.  Spark cuts each partition to ``most`` rows a site before it shuffles them.
    """
    both = reduce(DataFrame.unionByName, [s.select(*EVENT) for s in sources])
    placed = both.join(members, "controller_uid", "left").withColumn("system_id", F.coalesce("system_id", F.when(F.col("controller_uid").isNull(), F.lit(default_system))))
    order = Window.partitionBy("system_id").orderBy(F.desc("observed_at"), F.desc("event_id"))
    ranked = placed.where("system_id is not null").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= most).select("system_id", "place", *EVENT)
