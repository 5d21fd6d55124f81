"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.functions import decoders, text, words
from gridlore.operators import daily, history, outlook, site
from gridlore.operators.series import day_bounds
from gridlore.sources import lens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

E = """e AS (SELECT event_id AS sample_id, user_id AS device_id, user_id // 3 AS controller_id, ts AS observed_at,
  event_type AS register_name, value AS numeric_value, event_type AS state, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"""
R = """r AS (SELECT o_custkey // 10 AS device_id, CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS day,
  o_orderdate AS retrieved_at, o_orderkey AS record_id, o_totalprice AS charge_wh, o_orderstatus <> 'P' AS is_complete FROM orders),
rr AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY device_id, day ORDER BY retrieved_at DESC, record_id DESC) = 1)"""
SERIES = "OVER (PARTITION BY device_id ORDER BY observed_at, sample_id)"
CHANGES = f"""c AS (SELECT *, CASE WHEN lag(state) {SERIES} <> state THEN 1 ELSE 0 END AS changed, lag(state) {SERIES} AS previous FROM e)"""
DAYS = f"""live AS (SELECT device_id, CAST(observed_at AS DATE) AS day, count(*) AS live FROM e GROUP BY ALL),
ids AS (SELECT device_id FROM e UNION SELECT device_id FROM r),
spine AS (SELECT device_id, CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS day FROM ids, range(30) t(i)),
d AS (SELECT device_id, day, coalesce(live, 0) AS live, charge_wh, is_complete, CASE WHEN coalesce(live, 0) > 0 THEN 'live'
  WHEN is_complete THEN 'recovered' WHEN is_complete IS NOT NULL THEN 'partial' ELSE 'missing' END AS status
  FROM spine LEFT JOIN live USING (device_id, day) LEFT JOIN rr USING (device_id, day))"""


def as_bigint(sql: str) -> str:
    """DuckDB's count_if gives HUGEINT; counts are BIGINT here."""
    parts = sql.split("count_if(")
    out = parts[0]
    for part in parts[1:]:
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(part[end], 0)
            end += 1
        out += f"CAST(count_if({part[:end]} AS BIGINT){part[end:]}"
    return out


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = as_bigint(sql)
        return f

    return register


BY_REGISTER, BY_DEVICE = ["device_id", "register_name"], ["device_id"]


def bucket_sql(keys: str, seconds: int) -> str:
    return f"""WITH {E} SELECT {keys}, sec // {seconds} * {seconds} AS bucket_start, count(*) AS n, min(numeric_value) AS low,
  max(numeric_value) AS high, round(avg(numeric_value), 6) AS mean, arg_min(numeric_value, (observed_at, sample_id)) AS first_value,
  arg_max(numeric_value, (observed_at, sample_id)) AS last_value FROM e GROUP BY ALL"""


@query(bucket_sql("device_id, register_name", 21600))
def bucketed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.numeric_buckets(lens.samples(spark, sf_dir), BY_REGISTER, 21600)


@query(bucket_sql("register_name", 900))
def bucketed_history_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.numeric_buckets(lens.samples(spark, sf_dir), ["register_name"], 900)


@query(f"""WITH {E}, {CHANGES} SELECT device_id, sec // 86400 * 86400 AS bucket_start, count(*) AS n,
  arg_min(state, (observed_at, sample_id)) AS first_state, arg_max(state, (observed_at, sample_id)) AS last_state,
  CAST(sum(changed) AS BIGINT) AS transitions FROM c GROUP BY ALL""")
def bucketed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.state_buckets(lens.samples(spark, sf_dir), BY_DEVICE, 86400)


@query(f"""WITH {E} SELECT device_id, register_name, count(*) AS n, min(numeric_value) AS low, max(numeric_value) AS high,
  round(avg(numeric_value), 6) AS mean, arg_min(numeric_value, (observed_at, sample_id)) AS first_value,
  arg_max(numeric_value, (observed_at, sample_id)) AS last_value, min(observed_at) AS first_at, max(observed_at) AS last_at,
  arg_min(observed_at, (numeric_value, observed_at, sample_id)) AS low_at,
  arg_min(observed_at, (-numeric_value, observed_at, sample_id)) AS high_at,
  round(arg_max(numeric_value, (observed_at, sample_id)) - arg_min(numeric_value, (observed_at, sample_id)), 6) AS delta,
  max(sec) - min(sec) AS duration_s FROM e GROUP BY ALL""")
def register_stats_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.numeric_stats(lens.samples(spark, sf_dir), BY_REGISTER)


@query(f"""WITH {E}, {CHANGES} SELECT device_id, count(*) AS n, arg_min(state, (observed_at, sample_id)) AS first_state,
  arg_max(state, (observed_at, sample_id)) AS last_state, min(observed_at) AS first_at, max(observed_at) AS last_at,
  CAST(sum(changed) AS BIGINT) AS transitions FROM c GROUP BY ALL""")
def register_stats_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.state_stats(lens.samples(spark, sf_dir), BY_DEVICE)


@query(f"WITH {E} SELECT device_id, state, count(*) AS n FROM e GROUP BY ALL")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.samples(spark, sf_dir).groupBy("device_id", "state").agg(F.count("*").alias("n"))


@query(f"""WITH {E} SELECT min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS n,
  max(sec) - min(sec) AS duration_s, count(DISTINCT register_name) AS registers, count_if(state = 'error') AS errors,
  round(avg(numeric_value), 6) AS mean FROM e""")
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = history.epoch_seconds(F.col("observed_at"))
    return lens.samples(spark, sf_dir).agg(
        F.min("observed_at").alias("first_at"),
        F.max("observed_at").alias("last_at"),
        F.count("*").alias("n"),
        (F.max(sec) - F.min(sec)).alias("duration_s"),
        F.countDistinct("register_name").alias("registers"),
        F.count_if(F.col("state") == "error").alias("errors"),
        F.round(F.avg("numeric_value"), 6).alias("mean"),
    )


def latest_sql(key: str) -> str:
    return f"""WITH {E} SELECT {key}, sample_id, observed_at, register_name, numeric_value FROM e
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY observed_at DESC, sample_id DESC) = 1"""


@query(latest_sql("device_id"))
def latest_per_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.samples(spark, sf_dir).select("device_id", "sample_id", "observed_at", "register_name", "numeric_value")
    return history.latest(rows, BY_DEVICE)


@query(latest_sql("controller_id"))
def latest_per_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.samples(spark, sf_dir).select("controller_id", "sample_id", "observed_at", "register_name", "numeric_value")
    return history.latest(rows, ["controller_id"])


@query(f"""WITH {E} SELECT sample_id, device_id, observed_at, register_name, numeric_value FROM e
  WHERE observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-20'
  ORDER BY observed_at DESC, sample_id DESC LIMIT 500""")
def raw_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 rows of a period: a page is the feature."""
    rows = history.between(
        lens.samples(spark, sf_dir), F.expr("timestamp_ntz'2024-01-05'"), F.expr("timestamp_ntz'2024-01-20'")
    )
    page = rows.orderBy(F.desc("observed_at"), F.desc("sample_id")).limit(500)
    return page.select("sample_id", "device_id", "observed_at", "register_name", "numeric_value")


@query(f"""WITH {E} SELECT controller_id, device_id AS source_device_id, count(*) AS n, max(observed_at) AS last_at
  FROM e WHERE controller_id % 5 = 2 GROUP BY ALL""")
def scope_union_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All devices that the controllers of one site have ever had."""
    rows = lens.samples(spark, sf_dir)
    members = rows.select("device_id", "controller_id").distinct().where("controller_id % 5 = 2")
    found = history.in_scope(rows, members)
    return found.groupBy("controller_id", F.col("device_id").alias("source_device_id")).agg(
        F.count("*").alias("n"), F.max("observed_at").alias("last_at")
    )


@query(f"""WITH {E} SELECT controller_id % 5 AS system_id, controller_id, device_id AS source_device_id, count(*) AS n,
  max(observed_at) AS last_at FROM e GROUP BY ALL""")
def scope_union_history_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All devices that the controllers of each site have ever had."""
    rows = lens.samples(spark, sf_dir)
    members = rows.select("device_id", "controller_id").distinct()
    found = history.in_scope(rows, members).withColumn("system_id", F.expr("controller_id % 5"))
    return found.groupBy("system_id", "controller_id", F.col("device_id").alias("source_device_id")).agg(
        F.count("*").alias("n"), F.max("observed_at").alias("last_at")
    )


@query(f"WITH {E} SELECT device_id, CAST(observed_at AS DATE) AS day, count(*) AS live FROM e GROUP BY ALL")
def daily_live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.live_days(lens.samples(spark, sf_dir), BY_DEVICE)


def states_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = lens.samples(spark, sf_dir).select("device_id", F.to_date("observed_at").alias("day"), F.lit(1).alias("live"))
    return daily.day_states(live, lens.retained(spark, sf_dir), BY_DEVICE, F.expr("date'2024-01-01'"), 30)


@query(f"""WITH {E}, {R}, {DAYS} SELECT device_id, count(*) AS days, count_if(live > 0) AS live_days,
  count_if(status = 'recovered') AS recovered_days, count_if(live > 0 OR coalesce(is_complete, false)) AS covered_days,
  count(*) - count_if(live > 0 OR coalesce(is_complete, false)) AS missing_days,
  round(count_if(live > 0 OR coalesce(is_complete, false)) * 100.0 / count(*), 2) AS covered_percent FROM d GROUP BY ALL""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.coverage(states_of_days(spark, sf_dir), BY_DEVICE)


@query(f"""WITH {E}, {R}, {DAYS}, g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY device_id, status ORDER BY day) AS INTEGER) AS island
  FROM d WHERE status <> 'live') SELECT device_id, status, CAST(min(day) AS DATE) AS from_day, CAST(max(day) + 1 AS DATE) AS to_day,
  count(*) AS days FROM g GROUP BY device_id, status, island""")
def gap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.gaps(states_of_days(spark, sf_dir), BY_DEVICE)


@query(f"WITH {R} SELECT device_id, day AS controller_day, retrieved_at, record_id, charge_wh, is_complete FROM rr")
def retained_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.newest_records(lens.retained(spark, sf_dir), BY_DEVICE)


@query(f"""WITH {R} SELECT device_id, count(*) AS days, count_if(is_complete) AS complete_days, min(day) AS first_day,
  max(day) AS last_day, round(sum(charge_wh), 3) AS charge_wh FROM rr GROUP BY ALL""")
def retained_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = daily.newest_records(lens.retained(spark, sf_dir), BY_DEVICE)
    return newest.groupBy("device_id").agg(
        F.count("*").alias("days"),
        F.count_if("is_complete").alias("complete_days"),
        F.min("controller_day").alias("first_day"),
        F.max("controller_day").alias("last_day"),
        F.round(F.sum("charge_wh"), 3).alias("charge_wh"),
    )


@query(f"""WITH {E}, {R} SELECT rr.device_id, rr.day, count(e.sample_id) AS live FROM rr LEFT JOIN e ON e.device_id = rr.device_id
  AND e.observed_at >= CAST(rr.day AS TIMESTAMP) + INTERVAL 5 HOUR AND e.observed_at < CAST(rr.day AS TIMESTAMP) + INTERVAL 29 HOUR GROUP BY ALL""")
def retained_range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live samples in each record's local day, in a zone five hours behind UTC: dealt by the UTC dates that it touches."""
    days = daily.newest_records(lens.retained(spark, sf_dir), BY_DEVICE).select("device_id", F.col("controller_day").alias("day"))
    start, end = day_bounds(F.col("day"), "Etc/GMT+5")
    touched = days.withColumn("utc_day", F.explode(F.array("day", F.date_add("day", 1))))
    own = lens.samples(spark, sf_dir).select("device_id", "observed_at", F.to_date("observed_at").alias("utc_day"))
    met = touched.join(own, ["device_id", "utc_day"], "left")
    inside = F.coalesce((F.col("observed_at") >= start) & (F.col("observed_at") < end), F.lit(False))
    return met.groupBy("device_id", "day").agg(F.count_if(inside).alias("live"))


ENERGY = f"""p AS (SELECT *, CAST(observed_at AS DATE) AS day, epoch_us(observed_at) AS us FROM e),
q AS (SELECT device_id, day, (us - lag(us) OVER w) / 1e6 AS dt, numeric_value + lag(numeric_value) OVER w AS pair FROM p
  WINDOW w AS (PARTITION BY device_id, day ORDER BY observed_at, sample_id)),
en AS (SELECT device_id, day, count(*) AS n,
  CASE WHEN count(*) >= 2 THEN round(sum(CASE WHEN dt > 0 AND dt <= 21600 THEN pair / 2 * dt / 3600 ELSE 0 END), 3) END AS wh,
  round(sum(CASE WHEN dt > 0 AND dt <= 21600 THEN dt ELSE 0 END), 3) AS integrated_s,
  round(sum(CASE WHEN dt > 21600 THEN dt ELSE 0 END), 3) AS skipped_s FROM q GROUP BY ALL)"""


def local_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.energy(lens.samples(spark, sf_dir), BY_DEVICE, 6 * 3600)


@query(f"WITH {E}, {ENERGY} SELECT * FROM en")
def energy_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_energy(spark, sf_dir)


@query(f"""WITH {E}, {R}, {ENERGY} SELECT device_id, day, wh, charge_wh, round(wh - charge_wh, 3) AS difference_wh,
  CASE WHEN charge_wh <> 0 THEN round(round(wh - charge_wh, 3) / charge_wh * 100, 2) END AS difference_percent
  FROM en FULL OUTER JOIN rr USING (device_id, day)""")
def energy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.compare_energy(local_energy(spark, sf_dir), lens.retained(spark, sf_dir), BY_DEVICE)


@query(f"""WITH {E}, {ENERGY} SELECT device_id, count(wh) AS days, round(sum(wh), 3) AS wh, round(sum(skipped_s), 3) AS skipped_s
  FROM en GROUP BY ALL""")
def energy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_energy(spark, sf_dir).groupBy("device_id").agg(
        F.count("wh").alias("days"), F.round(F.sum("wh"), 3).alias("wh"), F.round(F.sum("skipped_s"), 3).alias("skipped_s")
    )


@query(f"WITH {E} SELECT DISTINCT register_name, sha256(register_name) AS register_key FROM e")
def register_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lens.samples(spark, sf_dir).select("register_name").distinct()
    return names.withColumn("register_key", F.sha2("register_name", 256))


def tier_sql(seconds: int) -> str:
    series = "OVER (PARTITION BY device_id, register_name ORDER BY observed_at, sample_id)"
    return f"""WITH {E}, c AS (SELECT *, CASE WHEN lag(state) {series} <> state THEN 1 ELSE 0 END AS changed FROM e
  WHERE observed_at < TIMESTAMP '2024-01-25')
SELECT device_id, register_name, sec // {seconds} * {seconds} AS bucket_start, count(*) AS n, min(numeric_value) AS low, max(numeric_value) AS high,
  round(avg(numeric_value), 6) AS mean, arg_min(numeric_value, (observed_at, sample_id)) AS first_value,
  arg_max(numeric_value, (observed_at, sample_id)) AS last_value, 'numeric' AS kind, NULL AS first_state, NULL AS last_state,
  CAST(NULL AS BIGINT) AS transitions FROM c GROUP BY ALL
UNION ALL
SELECT device_id, register_name, sec // {seconds} * {seconds}, count(*), NULL, NULL, NULL, NULL, NULL, 'state',
  arg_min(state, (observed_at, sample_id)), arg_max(state, (observed_at, sample_id)), CAST(sum(changed) AS BIGINT) FROM c
  GROUP BY device_id, register_name, sec // {seconds} * {seconds}"""


@query(tier_sql(60))
def tier_rollup_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.tier(lens.samples(spark, sf_dir), 60, F.expr("timestamp_ntz'2024-01-25'"))


@query(tier_sql(300))
def tier_rollup_300(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.tier(lens.samples(spark, sf_dir), 300, F.expr("timestamp_ntz'2024-01-25'"))


@query(f"""WITH {E}, {CHANGES}, n AS (SELECT *, sum(changed) OVER (PARTITION BY device_id ORDER BY observed_at, sample_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT device_id, state, min(observed_at) AS started_at, max(observed_at) AS ended_at, count(*) AS n FROM n GROUP BY device_id, run, state""")
def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.state_runs(lens.samples(spark, sf_dir), BY_DEVICE)


@query(f"""WITH {E}, {CHANGES} SELECT device_id, observed_at, previous, state, CASE WHEN state = 'error' THEN 'critical' ELSE 'info' END AS severity
  FROM c WHERE changed = 1""")
def transition_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.with_changes(lens.samples(spark, sf_dir), BY_DEVICE).where("changed = 1")
    severity = F.when(F.col("state") == "error", "critical").otherwise("info")
    return rows.select("device_id", "observed_at", "previous", "state", severity.alias("severity"))


KEPT = """WITH RECURSIVE o AS (SELECT user_id AS device_id, ts AS observed_at, event_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT device_id, observed_at, sample_id, n, observed_at AS last, true AS kept FROM o WHERE n = 1
UNION ALL SELECT o.device_id, o.observed_at, o.sample_id, o.n, CASE WHEN o.observed_at >= f.last + INTERVAL 12 HOUR THEN o.observed_at ELSE f.last END,
  o.observed_at >= f.last + INTERVAL 12 HOUR FROM f JOIN o ON o.device_id = f.device_id AND o.n = f.n + 1)
SELECT device_id, observed_at, sample_id FROM f WHERE kept"""


@query(KEPT)
def rate_limited_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.samples(spark, sf_dir).select("device_id", "observed_at", "sample_id")
    return history.rate_limited(rows, BY_DEVICE, 12 * 3600)


ALIASES = [("battery", "click", 1), ("battery", "view", 2), ("output", "purchase", 1), ("output", "signup", 2)]
A = "a(metric, register_name, priority) AS (VALUES " + ", ".join(f"('{m}', '{r}', {p})" for m, r, p in ALIASES) + ")"
PICK = f"""l AS (SELECT controller_id, register_name, arg_max(numeric_value, (observed_at, sample_id)) AS value FROM e GROUP BY ALL),
k AS (SELECT controller_id, metric, arg_min(value, (priority, register_name)) AS value FROM l JOIN a USING (register_name) WHERE value IS NOT NULL GROUP BY ALL)"""


def alias_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "metric string, register_name string, priority int")


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = lens.samples(spark, sf_dir).groupBy("controller_id", "register_name").agg(
        F.max_by("numeric_value", history.at()).alias("value")
    )
    return site.pick_alias(newest, alias_frame(spark), ["controller_id"])


@query(f"""WITH {E}, {A}, {PICK}, s AS (SELECT controller_id % 5 AS system_id, count(DISTINCT controller_id) AS expected FROM e GROUP BY ALL)
SELECT k.controller_id % 5 AS system_id, metric, count(value) AS contributors, round(sum(value), 6) AS total, round(median(value), 6) AS middle,
  min(value) AS low, max(value) AS high, CASE WHEN count(value) = 0 THEN 'empty' WHEN max(expected) = 0 OR count(value) >= max(expected)
  THEN 'complete' ELSE 'partial' END AS quality FROM k JOIN s ON s.system_id = k.controller_id % 5 GROUP BY ALL""")
def site_latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = F.expr("controller_id % 5").alias("system_id")
    expected = lens.samples(spark, sf_dir).groupBy(system).agg(F.countDistinct("controller_id").alias("expected"))
    rows = picked(spark, sf_dir).withColumn("system_id", F.expr("controller_id % 5")).join(expected, "system_id")
    return site.over_controllers(rows, ["system_id"], F.col("expected"))


@query(f"""WITH {E}, {A}, b AS (SELECT controller_id, device_id, register_name, sec // 86400 * 86400 AS bucket_start, avg(numeric_value) AS value FROM e GROUP BY ALL),
k AS (SELECT controller_id, bucket_start, metric, arg_min(value, (priority, device_id)) AS value FROM b JOIN a USING (register_name) GROUP BY ALL)
SELECT controller_id % 5 AS system_id, bucket_start, metric, count(*) AS contributors, round(sum(value), 6) AS total, round(median(value), 6) AS middle
  FROM k GROUP BY ALL""")
def site_bucketed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages by bucket, device and register, one alias a controller, then over controllers."""
    rows = lens.samples(spark, sf_dir)
    start = history.bucket(F.col("observed_at"), 86400).alias("bucket_start")
    means = rows.groupBy("controller_id", "device_id", "register_name", start).agg(F.avg("numeric_value").alias("value"))
    chosen = means.join(alias_frame(spark), "register_name").groupBy("controller_id", "bucket_start", "metric").agg(
        F.min_by("value", F.struct("priority", "device_id")).alias("value")
    )
    return chosen.groupBy(F.expr("controller_id % 5").alias("system_id"), "bucket_start", "metric").agg(
        F.count("*").alias("contributors"),
        F.round(F.sum("value"), 6).alias("total"),
        F.round(F.median("value"), 6).alias("middle"),
    )


@query(f"""WITH {E}, v AS (SELECT controller_id, device_id, register_name, arg_max(numeric_value, (observed_at, sample_id)) AS value FROM e GROUP BY ALL)
SELECT controller_id, register_name, count(value) AS sources, round(max(value) - min(value), 6) AS spread,
  CASE WHEN count(value) = 1 THEN 'single' WHEN max(value) - min(value) <= greatest(5.0, 0.05 * abs(median(value))) THEN 'agreed' ELSE 'conflict' END AS resolution,
  CASE WHEN count(value) = 1 OR max(value) - min(value) <= greatest(5.0, 0.05 * abs(median(value))) THEN round(median(value), 6) END AS value
  FROM v GROUP BY ALL""")
def consensus_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = lens.samples(spark, sf_dir).groupBy("controller_id", "device_id", "register_name").agg(
        F.max_by("numeric_value", history.at()).alias("value")
    )
    return site.consensus(reports, ["controller_id", "register_name"], 5.0, 0.05)


@query("""WITH p AS (SELECT CAST((hour(ts) * 60 + minute(ts)) // 15 * 15 AS BIGINT) AS slot, value FROM events WHERE event_type = 'purchase')
SELECT slot, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.9), 6) AS p90 FROM p GROUP BY ALL""")
def solar_curve_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.slot_curve(lens.samples(spark, sf_dir).where("register_name = 'purchase'"))


@query(f"""WITH {E}, b AS (SELECT device_id, CAST(observed_at AS DATE) AS day, sec // 900 AS slot, avg(numeric_value) AS value FROM e GROUP BY ALL)
SELECT device_id, day, count(*) AS slots, round(sum(greatest(value, 0) * 0.25), 6) AS energy FROM b GROUP BY ALL HAVING count(*) >= 2""")
def daily_curve_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlook.curve_energy(lens.samples(spark, sf_dir), BY_DEVICE)


@query("""WITH d AS (SELECT user_id % 5 AS system_id, CAST(ts AS DATE) AS day, round(sum(value), 6) AS energy FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY day) AS i FROM d),
f AS (SELECT a.system_id, a.day, a.energy, median(b.energy) AS forecast, count(*) AS past FROM n a JOIN n b ON a.system_id = b.system_id AND b.i < a.i AND b.i >= a.i - 28 GROUP BY ALL)
SELECT system_id, day, round(energy, 4) AS energy, round(forecast, 4) AS forecast, round(abs(forecast - energy) / energy * 100, 4) AS ape FROM f WHERE past >= 5 AND energy > 0""")
def backtest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.samples(spark, sf_dir).groupBy(F.expr("device_id % 5").alias("system_id"), F.to_date("observed_at").alias("day")).agg(
        F.round(F.sum("numeric_value"), 6).alias("energy")
    )
    return site.walk_forward(rows, ["system_id"]).select(
        "system_id", "day", *[F.round(c, 4).alias(c) for c in ("energy", "forecast", "ape")]
    )


@query(f"""WITH {E}, d AS (SELECT device_id % 5 AS system_id, CAST(observed_at AS DATE) AS day, count(*) AS n,
  min(CASE WHEN state = 'purchase' THEN CAST(hour(observed_at) * 60 + minute(observed_at) AS BIGINT) END) AS minute_ FROM e GROUP BY ALL HAVING count(*) >= 3)
SELECT system_id, count(*) AS observed_days, count(minute_) AS float_days, round(count(minute_) / count(*), 6) AS probability,
  round(median(minute_), 6) AS median_minute FROM d GROUP BY ALL""")
def float_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.samples(spark, sf_dir).withColumn("system_id", F.expr("device_id % 5"))
    return outlook.state_probability(outlook.state_days(rows, ["system_id"], "purchase"), ["system_id"])


@query(f"""WITH {E}, m AS (SELECT device_id % 5 AS system_id, CAST(observed_at AS DATE) AS day, avg(numeric_value) AS mean FROM e
  WHERE abs(hour(observed_at) * 60 + minute(observed_at) - 720) <= 45 GROUP BY ALL)
SELECT system_id, count(*) AS days, round(quantile_cont(mean, 0.1), 6) AS low, round(quantile_cont(mean, 0.5), 6) AS middle,
  round(quantile_cont(mean, 0.9), 6) AS high FROM m GROUP BY ALL""")
def baseline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each day within 45 minutes of noon, and their percentiles over days."""
    return outlook.baseline(lens.samples(spark, sf_dir).withColumn("system_id", F.expr("device_id % 5")), ["system_id"], 720)


@query(f"""WITH {E}, s AS (SELECT device_id, state, lead(sec) {SERIES} - sec AS after, lag(state) {SERIES} AS before FROM e)
SELECT device_id, state, CAST(sum(CASE WHEN after BETWEEN 0 AND 43200 THEN after ELSE 0 END) AS BIGINT) AS seconds,
  count_if(before IS NULL OR before <> state) AS entries FROM s GROUP BY ALL""")
def charge_cycle_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.durations(lens.samples(spark, sf_dir), BY_DEVICE, 43200)



def half_findings(rows: DataFrame, low: float, high: float) -> DataFrame:
    device = F.col("device_id").cast("string")
    return (
        rows.groupBy("device_id", "register_name")
        .agg(F.max("numeric_value").alias("top"))
        .where(F.col("top") > low)
        .select(
            F.concat_ws("|", device, "register_name").alias("fingerprint"),
            F.concat_ws("|", "register_name", device).alias("evaluation_key"),
            F.when(F.col("top") > high, "critical").otherwise("warning").alias("severity"),
        )
    )


@query("""WITH f AS (SELECT CAST(user_id AS VARCHAR) || '|' || event_type AS fingerprint, event_type || '|' || CAST(user_id AS VARCHAR) AS k,
  ts < TIMESTAMP '2024-01-16' AS old, max(value) AS top FROM events GROUP BY ALL),
o AS (SELECT fingerprint, k, CASE WHEN top > 150 THEN 'critical' ELSE 'warning' END AS sev FROM f WHERE old AND top > 80),
n AS (SELECT fingerprint, k, CASE WHEN top > 150 THEN 'critical' ELSE 'warning' END AS sev FROM f WHERE NOT old AND top > 80),
v AS (SELECT DISTINCT k FROM f WHERE NOT old)
SELECT fingerprint, coalesce(n.k, o.k) AS evaluation_key, CASE WHEN o.k IS NULL THEN 'opened' WHEN n.k IS NOT NULL AND o.sev = n.sev THEN 'unchanged'
  WHEN n.k IS NOT NULL THEN 'updated' WHEN coalesce(n.k, o.k) IN (SELECT k FROM v) THEN 'resolved' ELSE 'kept' END AS action,
  CAST((o.k IS NOT NULL)::INT + (n.k IS NOT NULL)::INT AS BIGINT) AS occurrences,
  coalesce(n.sev, o.sev) AS severity FROM o FULL OUTER JOIN n USING (fingerprint)""")
def incident_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.samples(spark, sf_dir)
    middle = F.expr("timestamp_ntz'2024-01-16'")
    before, after = history.between(rows, None, middle), history.between(rows, middle)
    seen = after.select(F.concat_ws("|", "register_name", F.col("device_id").cast("string")).alias("evaluation_key"))
    return site.reconcile(half_findings(before, 80, 150), half_findings(after, 80, 150), seen)


KIND_OF = {"view": "production", "click": "charging", "purchase": "battery", "signup": "other"}


@query("""WITH f AS (SELECT user_id AS device_id, CASE event_type WHEN 'view' THEN 'production' WHEN 'click' THEN 'charging' WHEN 'purchase' THEN 'battery'
  WHEN 'signup' THEN 'other' END AS category, CASE WHEN value > 150 THEN 20 WHEN value > 80 THEN 8 ELSE 2 END AS cost FROM events WHERE value > 120),
l AS (SELECT device_id, coalesce(category, 'data_integrity') AS category, least(20, sum(cost)) AS lost, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT device_id, sum(CASE WHEN category = 'other' THEN 0 ELSE lost END) AS lost, sum(n) AS n FROM l GROUP BY ALL),
s AS (SELECT u.device_id, 100 - coalesce(lost, 0) AS score, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id AS device_id FROM events) u LEFT JOIN d ON u.device_id = d.device_id)
SELECT device_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'warning' ELSE 'critical' END AS status,
  CAST(n AS BIGINT) AS active_incidents FROM s""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, kind = F.col("numeric_value"), F.col("register_name")
    rows = lens.samples(spark, sf_dir)
    category = F.lit(None).cast("string")
    for name, told in KIND_OF.items():
        category = F.when(kind == name, told).otherwise(category)
    found = rows.where(v > 120).select(
        "device_id",
        category.alias("category"),
        F.when(v > 150, "critical").when(v > 80, "warning").otherwise("info").alias("severity"),
    )
    return site.health_score(found, BY_DEVICE, rows)


@query("""SELECT l_suppkey AS device_id, count(*) AS n, round(count_if(l_returnflag <> 'R') / count(*), 6) AS success_rate,
  round(coalesce((count(*) - 1) / nullif(max(epoch(l_shipdate)) - min(epoch(l_shipdate)), 0), 0), 9) AS poll_rate,
  round(coalesce(sum(l_linenumber) / nullif(max(epoch(l_shipdate)) - min(epoch(l_shipdate)), 0), 0), 9) AS request_rate,
  round(avg(l_discount * 1000), 6) AS bus_mean, round(max(l_discount * 1000), 6) AS bus_max,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
  round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY ALL""")
def perf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.poll_summary(lens.polls(spark, sf_dir), BY_DEVICE)


@query("""WITH s AS (SELECT l_suppkey AS device_id, l_quantity AS interval_s, count_if(l_returnflag <> 'R') / count(*) AS success_rate,
  quantile_cont(l_extendedprice, 0.95) AS p95, count_if(l_extendedprice > 1000 * l_quantity) / count(*) AS miss_rate, max(l_discount * 1000) AS bus_max FROM lineitem GROUP BY ALL),
v AS (SELECT *, concat_ws(',', CASE WHEN success_rate < 0.98 THEN 'success' END, CASE WHEN p95 > 0.80 * 1000 * interval_s THEN 'latency' END,
  CASE WHEN miss_rate > 0.05 THEN 'deadline' END, CASE WHEN bus_max > 70 THEN 'bus' END) AS reasons FROM s)
SELECT device_id, interval_s, reasons, reasons = '' AS passed, min(reasons = '') OVER (PARTITION BY device_id ORDER BY interval_s DESC ROWS UNBOUNDED PRECEDING) AS usable FROM v""")
def stage_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = lens.polls(spark, sf_dir).groupBy("device_id", "interval_s").agg(
        (F.count_if("success") / F.count("*")).alias("success_rate"),
        F.percentile("latency_ms", F.lit(0.95)).alias("p95"),
        (F.count_if(F.col("latency_ms") > 1000 * F.col("interval_s")) / F.count("*")).alias("miss_rate"),
        F.max("bus_percent").alias("bus_max"),
    )
    return site.stage_verdicts(stages).select("device_id", "interval_s", "reasons", "passed", "usable")


W = "w AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7919) % 65536 AS w0, (l_suppkey * 104729 + l_linenumber) % 65536 AS w1 FROM lineitem)"
NIBBLES = " AND ".join(f"((w0 >> {4 * n}) & 15) <= 9" for n in range(4))


@query(f"""WITH {W} SELECT l_orderkey, l_linenumber, w0 - CASE WHEN w0 >= 32768 THEN 65536 ELSE 0 END AS s16, w0 * 65536 + w1 AS u32,
  (w0 - CASE WHEN w0 >= 32768 THEN 65536 ELSE 0 END) * 65536 + w1 AS s32, w0 + w1 / 65536.0::DOUBLE AS scale,
  CASE WHEN {NIBBLES} THEN (w0 & 15) + ((w0 >> 4) & 15) * 10 + ((w0 >> 8) & 15) * 100 + ((w0 >> 12) & 15) * 1000 ELSE w0 END AS bcd,
  CAST((w0 >> 8) & 255 AS VARCHAR) || '.' || CAST(w0 & 255 AS VARCHAR) AS version FROM w""")
def decode_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("w0"), F.col("w1")
    return lens.words(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        words.signed16(a).alias("s16"),
        words.unsigned32(a, b).alias("u32"),
        words.signed32(a, b).alias("s32"),
        words.fixed_point(a, b).alias("scale"),
        words.packed_decimal(a).alias("bcd"),
        words.version_pair(a).alias("version"),
    )


def float_sql(sign: str, exponent: str, mantissa: str, bits: int, bias: int) -> str:
    return f"""(CASE WHEN {sign} = 1 THEN -1.0 ELSE 1.0 END) * (CASE WHEN {exponent} = 0 THEN {mantissa} / {2**bits}.0::DOUBLE * pow(2.0, {1 - bias})
  WHEN {exponent} = {2 * bias + 1} AND {mantissa} = 0 THEN 'infinity'::DOUBLE WHEN {exponent} = {2 * bias + 1} THEN NULL
  ELSE (1 + {mantissa} / {2**bits}.0::DOUBLE) * pow(2.0, {exponent} - {bias}) END)"""


@query(f"WITH {W} SELECT l_orderkey, l_linenumber, w0, {float_sql('(w0 >> 15)', '((w0 >> 10) & 31)', '(w0 & 1023)', 10, 15)} AS value FROM w")
def decode_f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.words(spark, sf_dir).select("l_orderkey", "l_linenumber", "w0", words.binary16(F.col("w0")).alias("value"))


@query(
    f"WITH {W} SELECT l_orderkey, l_linenumber, {float_sql('(w0 >> 15)', '((w0 >> 7) & 255)', '((w0 & 127) * 65536 + w1)', 23, 127)} AS value FROM w"
)
def decode_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = words.binary32(F.col("w0"), F.col("w1"))
    return lens.words(spark, sf_dir).select("l_orderkey", "l_linenumber", value.alias("value"))


BITS = {0: "overcurrent", 1: "short", 2: "overtemp", 5: "highvolt"}
MODES = {0: "START", 1: "NIGHT", 2: "MPPT", 3: "ABSORPTION", 4: "FLOAT"}


@query(
    f"WITH {W} SELECT l_orderkey, l_linenumber, coalesce(nullif(concat_ws(', ', "
    + ", ".join(f"CASE WHEN (w0 >> {b}) & 1 = 1 THEN '{n}' END" for b, n in BITS.items())
    + "), ''), 'NONE') AS flags, CASE w1 % 8 "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in MODES.items())
    + " ELSE 'UNKNOWN_' || CAST(w1 % 8 AS VARCHAR) END AS mode FROM w"
)
def decode_bits_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.words(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        words.flags(F.col("w0"), BITS).alias("flags"),
        words.enumerated(F.col("w1") % 8, MODES).alias("mode"),
    )


DECODERS = (
    "raw", "s16", "bcd", "u32", "s32", "u32_factor:0.5", "factor:0.25", "udivide:8", "percent:250", "tristar_voltage", "tristar_current",
    "tristar_power", "tristar_rts_temp", "ts600_voltage", "suresine_classic_current", "bitfield_words", "byte_pair_version", "ascii_hi_lo", "none",
)
HALF = float_sql("(w0 >> 15)", "((w0 >> 10) & 31)", "(w0 & 1023)", 10, 15)
S16 = "(w0 - CASE WHEN w0 >= 32768 THEN 65536 ELSE 0 END)"
S32 = "((w0 - CASE WHEN w0 >= 32768 THEN 65536 ELSE 0 END) * 65536 + w1)"
PRINTED = "(65 + w0 % 26)"


@query(f"""WITH {W}, v AS (SELECT *, (l_orderkey + l_linenumber) % {len(DECODERS)} AS k, l_linenumber + w1 / 65536.0 AS volts, 2 * l_linenumber + w0 / 65536.0 AS amps,
  l_linenumber >= 4 AS floats, CASE WHEN l_linenumber * 50 >= 180 THEN 6.4 ELSE 17.0 END AS scale FROM w)
SELECT l_orderkey, l_linenumber, round(CAST(CASE k WHEN 0 THEN w0 WHEN 1 THEN {S16} WHEN 2 THEN CASE WHEN {NIBBLES} THEN
    (w0 & 15) + 10 * ((w0 >> 4) & 15) + 100 * ((w0 >> 8) & 15) + 1000 * (w0 >> 12) ELSE w0 END
  WHEN 3 THEN w0 * 65536 + w1 WHEN 4 THEN {S32} WHEN 5 THEN (w0 * 65536 + w1) * 0.5::DOUBLE WHEN 6 THEN {S16} * 0.25::DOUBLE
  WHEN 7 THEN w0 / 8.0::DOUBLE WHEN 8 THEN w0 * 100.0::DOUBLE / 250 WHEN 9 THEN {S16} * volts::DOUBLE / 32768 WHEN 10 THEN {S16} * amps::DOUBLE / 32768
  WHEN 11 THEN w0 * volts::DOUBLE * amps::DOUBLE / 131072 WHEN 12 THEN CASE WHEN w0 <> 128 THEN {S16} END
  WHEN 13 THEN CASE WHEN floats THEN {HALF} ELSE {S16} * volts::DOUBLE / 32768 END WHEN 14 THEN {S16} * scale::DOUBLE / 32768
  WHEN 15 THEN w0 + w1 * 65536 END AS DOUBLE), 4) + 0.0::DOUBLE AS number,
  CASE k WHEN 12 THEN CASE WHEN w0 = 128 THEN 'DISCONNECTED' END WHEN 16 THEN CAST(w0 >> 8 AS VARCHAR) || '.' || CAST(w0 & 255 AS VARCHAR)
  WHEN 17 THEN chr(CAST({PRINTED} AS INTEGER)) || 'x' END AS text FROM v""")
def decode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, line = F.col("w0"), F.col("w1"), F.col("l_linenumber")
    name = F.element_at(F.array(*map(F.lit, DECODERS)), ((F.col("l_orderkey") + line) % len(DECODERS) + 1).cast("int"))
    letters = (65 + a % 26) * 256 + ord("x")
    fields = F.when(name == "ascii_hi_lo", F.array(letters.cast("long"), F.lit(0).cast("long"))).otherwise(F.array(a.cast("long"), b.cast("long")))
    known = {0: line, 1: b, 2: 2 * line, 3: a, 4: F.when(line >= 4, 0x19).otherwise(0x18), 13: line * 50}
    context = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v.cast("long"))])
    made = decoders.decode(name, fields, context)
    rows = lens.words(spark, sf_dir).select("l_orderkey", "l_linenumber", made.alias("made"))
    return rows.select("l_orderkey", "l_linenumber", (F.round("made.number", 4) + 0.0).alias("number"), "made.text")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 10 END AS input_power,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity * 40 END AS output_power, l_quantity AS volts, CAST(l_linenumber AS DOUBLE) AS amps FROM lineitem),
x AS (SELECT *, coalesce(output_power, volts * amps) AS ref FROM v),
q AS (SELECT *, coalesce(CASE WHEN ref < 25 THEN input_power > 250 ELSE input_power > greatest(2 * ref, ref + 250) OR input_power < 0.5 * ref END, false) AS odd FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN input_power IS NULL THEN NULL WHEN odd THEN 'estimated_from_output' ELSE 'reported_unverified' END AS quality,
  CASE WHEN input_power IS NULL THEN NULL WHEN odd THEN 'charge_output_proxy' ELSE 'controller_reported' END AS source,
  CASE WHEN odd THEN ref ELSE input_power END AS power FROM q""")
def derived_input_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    values = lens.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(line != 7, F.col("l_extendedprice") / 10).alias("input_power"),
        F.when(line % 3 != 0, F.col("l_quantity") * 40).alias("output_power"),
        F.col("l_quantity").alias("volts"),
        line.cast("double").alias("amps"),
    )
    return site.derived_power(values).select("l_orderkey", "l_linenumber", "quality", "source", "power")


UNITS = ("V", "A", "C", "%", "Hz", "rpm")


@query(
    "WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 50 - 100 AS value, CASE l_orderkey % 6 "
    + " ".join(f"WHEN {n} THEN '{u}'" for n, u in enumerate(UNITS))
    + " END AS unit FROM lineitem) SELECT l_orderkey, l_linenumber, unit, CASE "
    + " ".join(
        f"WHEN unit = '{u}' THEN CASE WHEN value BETWEEN {lo} AND {hi} THEN 'plausible' ELSE 'implausible' END"
        for u, (lo, hi) in site.ENVELOPE.items()
    )
    + " ELSE 'unknown_unit' END AS verdict FROM v"
)
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("l_orderkey") % 6 + 1).cast("int"))
    values = lens.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 50 - 100).alias("value"), unit.alias("unit")
    )
    return site.plausibility(values).select("l_orderkey", "l_linenumber", "unit", "verdict")


@query("""WITH v AS (SELECT p_partkey, p_size AS major, p_partkey % 10 AS minor FROM part)
SELECT p_partkey, (major, minor) >= (19, 5) AS modern, (major, minor) <= (29, 0) AS legacy FROM v""")
def firmware_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
    none = F.lit(None).cast("string")
    return lens.table(spark, sf_dir, "part").select(
        "p_partkey",
        text.firmware_allows(version, F.lit("19.5"), none).alias("modern"),
        text.firmware_allows(version, none, F.lit("29")).alias("legacy"),
    )


@query("""SELECT r_name AS system, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS members FROM region
  LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def system_member_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members are counted by nation before they meet the small dimensions."""
    members = lens.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"))
    nations = lens.table(spark, sf_dir, "nation").join(members, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return (
        lens.table(spark, sf_dir, "region")
        .join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .groupBy(F.col("r_name").alias("system"))
        .agg(F.countDistinct("n_nationkey").alias("nations"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))
    )


@query("""SELECT c_custkey, c_name, n_name, r_name, count(o_orderkey) AS connections FROM customer JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def inventory_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = lens.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    places = lens.table(spark, sf_dir, "nation").join(
        lens.table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")
    )
    return (
        lens.table(spark, sf_dir, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(links, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("n", F.lit(0).cast("long")).alias("connections"))
    )


@query("""SELECT o_custkey AS controller_id, count(*) AS records FROM orders GROUP BY ALL
  HAVING max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 0""")
def legacy_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that have never been active."""
    return (
        lens.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("controller_id"))
        .agg(F.count("*").alias("records"), F.max(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("active"))
        .where("active = 0")
        .drop("active")
    )


@query("""SELECT l_partkey AS endpoint, count(DISTINCT l_suppkey) AS controllers FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1""")
def bridge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints that several controllers reach."""
    return (
        lens.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("endpoint"))
        .agg(F.countDistinct("l_suppkey").alias("controllers"))
        .where("controllers > 1")
    )


@query(f"""WITH {E}, {CHANGES} SELECT device_id, observed_at AS at, 'transition' AS kind, state AS detail FROM c WHERE changed = 1
UNION ALL SELECT user_id, ts, 'poll_error', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error'
UNION ALL SELECT o_custkey // 10, o_orderdate, 'sync', o_orderstatus FROM orders""")
def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.samples(spark, sf_dir)
    changes = history.with_changes(rows, BY_DEVICE).where("changed = 1")
    at = F.col("observed_at").alias("at")
    return (
        changes.select("device_id", at, F.lit("transition").alias("kind"), F.col("state").alias("detail"))
        .unionByName(
            rows.where("state = 'error'").select(
                "device_id", at, F.lit("poll_error").alias("kind"), F.col("sample_id").cast("string").alias("detail")
            )
        )
        .unionByName(
            lens.table(spark, sf_dir, "orders").select(
                F.expr("o_custkey div 10").alias("device_id"),
                F.col("o_orderdate").alias("at"),
                F.lit("sync").alias("kind"),
                F.col("o_orderstatus").alias("detail"),
            )
        )
    )


@query("""SELECT c_mktsegment AS status, count(*) AS n, count_if(c_acctbal < 0) AS offline FROM customer GROUP BY ALL""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("status")).agg(
        F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("offline")
    )


@query(f"""WITH {E}, p AS (SELECT controller_id, max(CASE WHEN register_name = 'purchase' THEN numeric_value END) AS solar,
  max(CASE WHEN register_name = 'click' THEN numeric_value END) AS load, max(CASE WHEN register_name = 'view' THEN numeric_value END) AS battery FROM e GROUP BY ALL)
SELECT controller_id, solar, load, battery, round(solar - load, 6) AS net, round(solar - load - battery, 6) AS unaccounted FROM p""")
def power_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics side by side and what follows from them; null where an input is missing."""
    return outlook.power_flow(powers(spark, sf_dir))


def powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name: F.max(F.when(F.col("register_name") == name, F.col("numeric_value")))
    return lens.samples(spark, sf_dir).groupBy("controller_id").agg(of("purchase").alias("solar"), of("click").alias("load"), of("view").alias("battery"))


@query(f"""WITH {E}, p AS (SELECT controller_id, max(CASE WHEN register_name = 'purchase' AND controller_id % 3 > 0 THEN numeric_value END) AS solar,
  max(CASE WHEN register_name = 'click' THEN numeric_value END) AS load, max(CASE WHEN register_name = 'view' AND controller_id % 2 > 0 THEN numeric_value END) AS battery FROM e GROUP BY ALL)
SELECT controller_id, 'net' AS name, round(solar - load, 6) AS value, CASE WHEN solar IS NULL OR load IS NULL THEN 'unavailable' ELSE 'complete' END AS status, 'solar - load' AS formula,
  concat_ws(',', CASE WHEN solar IS NULL THEN 'solar' END, CASE WHEN load IS NULL THEN 'load' END) AS missing FROM p
UNION ALL SELECT controller_id, 'unaccounted', round(solar - load - battery, 6), CASE WHEN solar IS NULL OR load IS NULL OR battery IS NULL THEN 'unavailable' ELSE 'complete' END, 'solar - load - battery',
  concat_ws(',', CASE WHEN solar IS NULL THEN 'solar' END, CASE WHEN load IS NULL THEN 'load' END, CASE WHEN battery IS NULL THEN 'battery' END) FROM p""")
def power_flow_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived powers with their formulas and the inputs that they lack; some controllers report no solar or battery power."""
    wide = powers(spark, sf_dir).withColumns({"solar": F.when(F.col("controller_id") % 3 > 0, F.col("solar")), "battery": F.when(F.col("controller_id") % 2 > 0, F.col("battery"))})
    return outlook.flow_payload(wide, ["controller_id"])


@query("""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count_if(regexp_matches(line, '[0-9]+')) AS numbered, CAST(sum(length(line)) AS BIGINT) AS chars FROM d GROUP BY ALL""")
def doc_register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text documents, and how many hold a number."""
    lines = lens.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("line").rlike("[0-9]+")).alias("numbered"),
        F.sum(F.length("line")).alias("chars"),
    )
