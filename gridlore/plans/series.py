"""Queries of chart and report reads, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.functions import text
from gridlore.operators import series
from gridlore.plans.telemetry import E, query
from gridlore.sources import lens

NOW = "2024-01-31 00:00:00"
S = f"""s AS (SELECT *, CASE WHEN device_id % 7 = 0 AND sample_id % 2 = 0 THEN 'text' ELSE 'numeric' END AS kind,
  CASE WHEN sample_id % 3 = 0 THEN CASE WHEN device_id % 2 = 0 THEN 'V' ELSE 'A' END END AS unit FROM e)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.samples(spark, sf_dir).selectExpr(
        "*",
        "CASE WHEN device_id % 7 = 0 AND sample_id % 2 = 0 THEN 'text' ELSE 'numeric' END AS kind",
        "CASE WHEN sample_id % 3 = 0 THEN CASE WHEN device_id % 2 = 0 THEN 'V' ELSE 'A' END END AS unit",
    )


@query(f"""WITH {E}, {S} SELECT device_id, register_name, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS kind,
  arg_min(unit, (observed_at, sample_id)) FILTER (unit IS NOT NULL) AS unit, count(*) AS n, min(observed_at) AS first_at,
  max(observed_at) AS last_at FROM s GROUP BY ALL""")
def series_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.headers(points(spark, sf_dir), ["device_id", "register_name"])


@query(f"""WITH {E} SELECT sample_id, device_id, register_name FROM e WHERE register_name IN ('click', 'error') AND observed_at >= TIMESTAMP '2024-01-05'""")
def named_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.named(lens.samples(spark, sf_dir), [" click", "error", "", "click "])
    return rows.where(F.col("observed_at") >= F.lit("2024-01-05").cast("timestamp_ntz")).select("sample_id", "device_id", "register_name")


@query("""SELECT o_orderkey AS record_id, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS day FROM orders
  WHERE o_orderkey % 30 BETWEEN 9 AND 18""")
def retained_days_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.in_days(lens.retained(spark, sf_dir), F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"))
    return rows.select("record_id", F.col("controller_day").alias("day"))


@query("""SELECT l_returnflag AS mode, count(*) AS n, count_if(nullif(l_linestatus, 'F') IS NULL OR nullif(l_linestatus, 'F') IN ('O')) AS open_or_unset
  FROM lineitem WHERE l_linenumber = 3 GROUP BY ALL""")
def polls_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.matching(lens.table(spark, sf_dir, "lineitem"), l_linenumber=3, l_suppkey=None)
    status = F.nullif("l_linestatus", F.lit("F"))
    return rows.groupBy(F.col("l_returnflag").alias("mode")).agg(
        F.count("*").alias("n"), F.count_if(series.in_or_unset(status, ["O"])).alias("open_or_unset")
    )


@query("""WITH v AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN printf('holding_0x%04X', l_partkey % 65536) WHEN 1 THEN printf('input_0x%04X', l_partkey % 65536)
  ELSE 'volts' END AS name FROM lineitem) SELECT name, count(*) AS n, NOT (name LIKE 'holding\\_0x%' ESCAPE '\\' OR name LIKE 'input\\_0x%' ESCAPE '\\') AS defined
  FROM v GROUP BY ALL""")
def register_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, address = F.col("l_linenumber"), F.col("l_partkey") % 65536
    name = F.when(line % 3 == 0, text.register_name(F.lit("holding"), address)).when(line % 3 == 1, text.register_name(F.lit("input"), address)).otherwise("volts")
    counts = lens.table(spark, sf_dir, "lineitem").select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    known = series.defined_only(counts, "name").select("name", "n", F.lit(True).alias("defined"))
    return known.unionByName(series.without(counts, known, ["name"]).select("name", "n", F.lit(False).alias("defined")))


@query(f"""WITH {E} SELECT device_id, max(observed_at) AS last_seen, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(observed_at))) / 1000.0::DOUBLE) AS age_ms,
  epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(observed_at)) <= 86400 * 1000000::BIGINT AS fresh FROM e GROUP BY ALL""")
def device_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = lens.samples(spark, sf_dir).groupBy("device_id").agg(F.max("observed_at").alias("last_seen"))
    now, last = F.lit(NOW).cast("timestamp_ntz"), F.col("last_seen")
    return seen.select("device_id", "last_seen", series.age_ms(now, last).alias("age_ms"), series.fresh(now, last, 86400).alias("fresh"))


ZONE = "America/Denver"


@query(f"""SELECT o_orderkey, CAST(epoch(timezone('{ZONE}', d)) AS BIGINT) AS starts, CAST(epoch(timezone('{ZONE}', d + INTERVAL 1 DAY)) AS BIGINT) AS ends
  FROM (SELECT o_orderkey, TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 366 AS INTEGER)) AS d FROM orders)""")
def local_day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("date_add(date'2024-01-01', CAST(o_orderkey % 366 AS INT))")
    seconds = lambda t: F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t)
    start, end = series.day_bounds(day, ZONE)
    return lens.table(spark, sf_dir, "orders").select("o_orderkey", seconds(start).alias("starts"), seconds(end).alias("ends"))


@query(f"""WITH {E}, {S}, w AS (SELECT DISTINCT register_name, coalesce(unit, '') AS unit FROM s WHERE device_id % 2 = 0)
SELECT sample_id, register_name, unit, length(register_name) + length(unit) AS entry FROM (SELECT sample_id, register_name, coalesce(unit, '') AS unit FROM s)
  JOIN w USING (register_name, unit)""")
def dictionary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    entries = rows.where("device_id % 2 = 0").select("register_name", "unit").distinct()
    entries = entries.withColumn("entry", (F.length("register_name") + F.coalesce(F.length("unit"), F.lit(0))).cast("long"))
    return series.described(rows.select("sample_id", "register_name", "unit"), entries, ["register_name"])


@query(f"""WITH {E} SELECT device_id, min(day) AS first_day, max(day) AS last_day FROM (SELECT device_id, CAST(observed_at AS DATE) AS day FROM e
  UNION ALL SELECT o_custkey // 10, CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS DATE) FROM orders) GROUP BY ALL""")
def day_range_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = lens.samples(spark, sf_dir).select("device_id", F.to_date("observed_at").alias("day"))
    kept = lens.retained(spark, sf_dir).select("device_id", F.col("controller_day").alias("day"))
    return series.day_range([live, kept], ["device_id"])


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n, count_if({s} = 'F') AS n_verified, CAST(sum(CASE WHEN {s} = 'F' THEN length({v}) END) AS BIGINT) AS verified_size FROM {t}"
    for t, (s, v) in {"orders": ("o_orderstatus", "o_orderpriority"), "lineitem": ("l_linestatus", "l_returnflag")}.items()
))
def storage_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "orders": lens.table(spark, sf_dir, "orders").selectExpr("o_orderstatus AS status", "o_orderpriority AS name"),
        "lineitem": lens.table(spark, sf_dir, "lineitem").selectExpr("l_linestatus AS status", "l_returnflag AS name"),
    }
    return series.accounts(tables, F.col("status") == "F", F.length("name"))


@query(f"""WITH {E}, c AS (SELECT *, CAST(observed_at AS DATE) AS day, coalesce(lag(state) OVER (PARTITION BY device_id, CAST(observed_at AS DATE)
  ORDER BY observed_at, sample_id) <> state, true) AS turned FROM e)
SELECT device_id, day, string_agg(state, '>' ORDER BY observed_at, sample_id) AS states FROM c WHERE turned GROUP BY ALL""")
def state_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.samples(spark, sf_dir).withColumn("day", F.to_date("observed_at"))
    found = series.state_sequence(rows, ["device_id", "day"], ["device_id"])
    return found.select("device_id", "day", F.array_join("states", ">").alias("states"))


@query(f"""WITH {E}, l AS (SELECT controller_id % 5 AS site_id, controller_id, sec // 21600 * 21600 AS bucket_start,
  arg_max(state, (observed_at, sample_id)) AS value, max(observed_at) AS observed_at FROM e GROUP BY ALL),
x AS (SELECT controller_id % 5 AS site_id, count(DISTINCT controller_id) AS expected FROM e GROUP BY ALL)
SELECT site_id, bucket_start, array_to_string(list_sort(list(DISTINCT value)), ',') AS states, count(*) AS contributors, min(observed_at) AS oldest_at,
  expected, CASE WHEN count(*) >= expected THEN 'complete' ELSE 'partial' END AS quality FROM l JOIN x USING (site_id) GROUP BY site_id, bucket_start, expected""")
def site_state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.samples(spark, sf_dir).withColumn("site_id", F.col("controller_id") % 5).withColumn("value", F.col("state"))
    expected = rows.groupBy("site_id").agg(F.countDistinct("controller_id").alias("expected"))
    found = series.state_set(series.last_of_each(rows, ["site_id"], 21600), ["site_id", "bucket_start"], expected, ["site_id"])
    return found.withColumn("states", F.array_join("states", ","))


@query("""WITH m AS (SELECT c_nationkey AS site_id, CASE WHEN c_acctbal >= 0 THEN 'online' WHEN c_acctbal >= -900 THEN 'offline' END AS status,
  c_custkey % 41 = 0 AS fault, c_custkey % 17 = 0 AS alarm FROM customer),
g AS (SELECT site_id, count_if(fault) AS active_faults, count_if(alarm) AS active_alarms, count_if(coalesce(status, '') <> 'online') AS offline,
  count(*) AS controllers FROM m GROUP BY ALL)
SELECT *, CASE WHEN active_faults > 0 THEN 'critical' WHEN active_alarms + offline > 0 THEN 'warning' ELSE 'ok' END AS health FROM g""")
def system_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, none = F.lit(None).cast("double"), F.lit(None).cast("string")
    controllers = lens.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("site_id"),
        F.when(F.col("c_acctbal") >= 0, "online").when(F.col("c_acctbal") >= -900, "offline").alias("status"),
        text.state_clear(number, F.when(F.col("c_custkey") % 41 == 0, "Over current").otherwise(" None ")).alias("fault_clear"),
        text.state_clear(F.when(F.col("c_custkey") % 17 == 0, 4.0).otherwise(0.0), none).alias("alarm_clear"),
    )
    return series.system_health(controllers, ["site_id"])


@query("""WITH m AS (SELECT c_custkey AS controller_id, c_nationkey % 6 AS profile FROM customer)
SELECT metric, controller_id FROM m JOIN (SELECT DISTINCT metric, profile FROM (SELECT n_regionkey AS profile, n_nationkey % 4 AS register FROM nation)
  JOIN (VALUES (0, 'charge'), (1, 'charge'), (3, 'state')) a(register, metric) USING (register)) USING (profile)""")
def eligible_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    controllers = lens.table(spark, sf_dir, "customer").selectExpr("c_custkey AS controller_id", "c_nationkey % 6 AS profile")
    registers = lens.table(spark, sf_dir, "nation").selectExpr("CAST(n_regionkey AS BIGINT) AS profile", "CAST(n_nationkey % 4 AS STRING) AS register_name")
    aliases = spark.createDataFrame([("0", "charge"), ("1", "charge"), ("3", "state")], "register_name string, metric string")
    return series.eligible(controllers, registers, aliases)


@query("""SELECT c_custkey AS controller_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey
  HAVING max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 0)""")
def shown_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controllers without the placeholders that have never been active."""
    placeholders = lens.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("controller_id")).agg(
        F.max(F.col("o_orderstatus") == "O").alias("active")
    )
    everyone = lens.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("controller_id"))
    return series.without(everyone, placeholders.where("not active"), ["controller_id"])


ALIASES = (("ANODIZED", "plated", 1), ("STANDARD", "plain", 2), ("STANDARD ANODIZED", "special", 1), ("STEEL", "steel", 3), ("TIN", "tin", 3))


@query("WITH a(alias, profile, priority) AS (VALUES " + ", ".join(map(str, ALIASES)) + """)
SELECT p_partkey, arg_min(profile, (priority, -length(alias), profile)) AS profile FROM part LEFT JOIN a ON contains(p_type, alias) GROUP BY ALL""")
def profile_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "part").select("p_partkey", series.by_alias(F.col("p_type"), list(ALIASES)).alias("profile"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN epoch_us(ts) // 1000 END AS at_ms FROM events""")
def lenient_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times printed with a zone, without one, with an offset, and texts that are none."""
    ts, kind = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 4
    plain = F.regexp_replace(ts.cast("string"), " ", "T")
    ahead = F.concat(F.regexp_replace((ts + F.expr("INTERVAL 2 HOURS")).cast("string"), " ", "T"), F.lit("+02:00"))
    printed = F.when(kind == 0, F.concat(plain, F.lit("Z"))).when(kind == 1, plain).when(kind == 2, ahead).otherwise("soon")
    return lens.table(spark, sf_dir, "events").select("event_id", F.unix_millis(text.lenient_time(printed)).alias("at_ms"))


PRINTED = ("Max. Battery Voltage:", " HOURMETER", "Amp-Hours :", "Equalization\tTimer", "nothing", "Alarm:")
FIELDS = ("battery_voltage_max", "hourmeter_hours", "charge_ah", "equalize_minutes", None, "alarms")


@query("SELECT o_orderkey, CASE o_orderkey % 6 " + " ".join(f"WHEN {n} THEN '{f}'" for n, f in enumerate(FIELDS) if f) + " END AS field FROM orders")
def label_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, PRINTED)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return lens.table(spark, sf_dir, "orders").select("o_orderkey", text.field_of(label).alias("field"))


@query("""SELECT user_id AS device_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rank
  FROM events QUALIFY rank <= 5""")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest of each device; equal times go by the id as a text."""
    rows = lens.table(spark, sf_dir, "events").selectExpr("user_id AS device_id", "event_id", "ts")
    order = [F.col("ts").desc(), F.col("event_id").cast("string").desc()]
    return series.newest(rows, ["device_id"], 5, order).select("device_id", "event_id", "rank")


@query("""WITH v AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'Float stage' WHEN 1 THEN 'absorption' WHEN 2 THEN 'EQUALIZE (manual)' WHEN 3 THEN 'night' END AS state FROM orders)
SELECT CASE WHEN upper(state) LIKE '%FLOAT%' THEN 'FLOAT' WHEN upper(state) LIKE '%ABSOR%' THEN 'ABSORPTION' WHEN upper(state) LIKE '%EQUAL%' THEN 'EQUALIZE' END AS phase,
  count(*) AS n FROM v GROUP BY ALL""")
def charge_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ("Float stage", "absorption", "EQUALIZE (manual)", "night", None)
    state = F.element_at(F.array(*[F.lit(s).cast("string") for s in said]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return lens.table(spark, sf_dir, "orders").groupBy(text.charge_phase(state).alias("phase")).agg(F.count("*").alias("n"))
