"""Queries on devices, findings, forecasts, upserts and streams, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.functions import frames
from gridlore.operators import findings, fleet, gates, outlook, site
from gridlore.plans.telemetry import CHANGES, KEPT, QUERIES, SQL, E, backtest_errors, float_probability, query
from gridlore.sources import archive, lens
from gridlore.sources.shared import shared_dir
from gridlore.streaming import live


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "orders")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "lineitem")


@query("""SELECT o_custkey AS device_id, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, count(*) AS observations,
  max(o_totalprice) AS confidence FROM orders GROUP BY ALL""")
def identity_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders(spark, sf_dir).selectExpr("o_custkey AS device_id", "o_orderdate AS observed_at", "o_totalprice AS confidence")
    return fleet.sightings(log, ["device_id"])


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'serial:' || lower(c_name) WHEN c_acctbal > 0
  THEN 'usb:' || lower(c_mktsegment) || ':' || CAST(c_custkey % 247 AS VARCHAR) ELSE 'endpoint:' || CAST(c_nationkey AS VARCHAR) END AS identity
  FROM customer""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = fleet.identity_key(
        F.when(F.col("c_acctbal") > 5000, F.col("c_name")).otherwise(" "),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")),
        F.col("c_custkey") % 247,
        F.col("c_nationkey").cast("string"),
    )
    return lens.table(spark, sf_dir, "customer").select("c_custkey", key.alias("identity"))


@query(f"""WITH {E}, s AS (SELECT *, sum(CASE WHEN state <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY observed_at, sample_id
  ROWS UNBOUNDED PRECEDING) AS successes FROM e), f AS (SELECT *, sum(CASE WHEN state = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY device_id, successes
  ORDER BY observed_at, sample_id ROWS UNBOUNDED PRECEDING) AS failures FROM s)
SELECT device_id, sample_id, CAST(failures AS BIGINT) AS failures, CASE WHEN failures = 0 THEN 'online' WHEN failures >= 2 THEN 'offline'
  WHEN successes = 0 THEN 'connecting' ELSE 'degraded' END AS status,
  least(CAST(60 AS DOUBLE), pow(2.0, greatest(failures - 1, 0))) AS wait_s FROM f""")
def device_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = lens.samples(spark, sf_dir).withColumn("success", F.col("state") != "error")
    return fleet.lifecycle(polls, ["device_id"], offline_after=2).select("device_id", "sample_id", "failures", "status", "wait_s")


@query("""SELECT l_orderkey AS device_id, arg_min(l_suppkey, (l_returnflag <> 'A', l_linenumber, l_suppkey)) AS endpoint, count(*) AS candidates
  FROM lineitem GROUP BY ALL""")
def preferred_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).selectExpr(
        "l_orderkey AS device_id", "l_suppkey AS endpoint", "l_linenumber AS rank", "l_returnflag = 'A' AS incumbent"
    )
    return fleet.preferred_endpoint(rows, ["device_id"])


@query("""WITH h AS (SELECT c_custkey // 3 AS host, min(c_custkey) AS low, max(c_custkey) AS high FROM customer WHERE c_acctbal > 3000 GROUP BY ALL)
SELECT o_orderkey, o_custkey // 3 AS host, CASE WHEN low = high THEN low END AS controller_id FROM orders LEFT JOIN h ON host = o_custkey // 3""")
def host_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = lens.table(spark, sf_dir, "customer").where("c_acctbal > 3000").selectExpr("c_custkey div 3 AS host", "c_custkey AS controller_id")
    events = orders(spark, sf_dir).selectExpr("o_orderkey", "o_custkey div 3 AS host")
    return fleet.assigned_by_host(events, candidates).select("o_orderkey", "host", "controller_id")


@query("""SELECT l_orderkey AS controller_id, CAST(l_linenumber AS BIGINT) AS slot, max(CAST(l_suppkey AS VARCHAR)) AS serial,
  max(CAST(l_partkey AS VARCHAR)) AS model FROM lineitem GROUP BY ALL""")
def connected_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "concat('connected_product_', l_linenumber, '_')"
    registers = lines(spark, sf_dir).selectExpr(
        "l_orderkey AS controller_id",
        f"""inline(array(struct({name} || 'serial' AS register_name, CAST(l_suppkey AS STRING) AS value),
            struct({name} || 'model' AS register_name, CAST(l_partkey AS STRING) AS value)))""",
    )
    return fleet.connected_products(registers, ["controller_id"], ["serial", "model"])


@query("""WITH m AS (SELECT 'controller:' || c_custkey AS c, c_nationkey AS s FROM customer)
SELECT c AS source, 'system:' || s AS target, 'member_of' AS relation, CAST(1 AS DOUBLE) AS confidence FROM m
UNION ALL SELECT c, 'bus:' || s, 'charges', 1 FROM m
UNION ALL SELECT DISTINCT 'controller:' || o_custkey, 'product:' || lower(o_orderpriority), 'monitors', 1 FROM orders""")
def component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = lens.table(spark, sf_dir, "customer").selectExpr("c_nationkey AS system_id", "c_custkey AS controller_id")
    products = orders(spark, sf_dir).selectExpr("o_custkey AS controller_id", "o_orderkey AS slot", "o_orderpriority AS serial")
    return fleet.component_graph(members, products)[1]


@query("""SELECT l_orderkey AS device_id, count(*) AS evidence, round(least(1.0, greatest(0.0, sum(CASE WHEN l_returnflag <> 'R' THEN l_tax * 4
  ELSE -(l_tax * 4) END))), 6) AS confidence FROM lineitem GROUP BY ALL""")
def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).selectExpr("l_orderkey AS device_id", "l_returnflag <> 'R' AS passed", "l_tax * 4 AS weight")
    return findings.confidence(rows, ["device_id"])


FIGURES = {
    "controller_id": "l_orderkey * 10 + l_linenumber",
    "status": "CASE WHEN l_linestatus = 'O' THEN 'online' ELSE 'offline' END",
    "terminal_v": "l_tax * 20",
    "sense_v": "CASE WHEN l_linenumber < 6 THEN l_discount * 20 END",
    "input_w": "l_extendedprice / 50",
    "output_w": "l_extendedprice / 50 * (1 - l_discount * 6)",
    "fault": "CASE l_returnflag WHEN 'N' THEN ' None ' WHEN 'A' THEN 'overcurrent' END",
    "alarm": "CASE WHEN l_linenumber < 3 THEN l_returnflag ELSE 'ok' END",
    "polls": "l_linenumber * 5",
    "success_rate": "1 - l_discount * 3",
    "miss_rate": "l_tax * 2",
    "state_samples": "l_linenumber",
    "absorptions": "CAST(l_quantity AS BIGINT) % 12",
    "days": "l_linenumber + 1",
    "coverage_percent": "l_quantity * 2",
    "solar_w": "l_quantity * 10",
    "solar_median": "l_discount * 5000",
    "solar_low": "CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE l_tax * 3000 END",
}
FOUND = {
    "controller_offline": ("true", "status <> 'online'", "false"),
    "battery_sense_divergence": ("terminal_v IS NOT NULL AND sense_v IS NOT NULL", "abs(terminal_v - sense_v) >= 0.25", "abs(terminal_v - sense_v) >= 0.5"),
    "controller_efficiency": ("output_w IS NOT NULL AND input_w >= 100", "output_w / input_w < 0.8", "output_w / input_w < 0.6"),
    "controller_fault": ("fault IS NOT NULL", "lower(trim(fault)) <> 'none'", "true"),
    "controller_alarm": ("alarm IS NOT NULL", "lower(trim(alarm)) <> 'ok'", "false"),
    "polling_degradation": ("polls >= 20", "success_rate < 0.95 OR miss_rate > 0.1", "success_rate < 0.8"),
    "charge_stage_cycling": ("state_samples >= 3", "absorptions >= 6", "absorptions >= 10"),
    "history_coverage": ("days >= 3", "coverage_percent < 80", "false"),
    "solar_underproduction": (
        "solar_median >= 100",
        "solar_w < least(0.6 * solar_median, 0.75 * coalesce(nullif(solar_low, 0), solar_median))",
        "solar_w < 0.25 * solar_median",
    ),
}


@query(
    f"WITH w AS (SELECT {', '.join(f'{v} AS {k}' for k, v in FIGURES.items())} FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT controller_id, '{n}' AS detector, CASE WHEN ({f}) AND ({c}) THEN 'critical' WHEN {f} THEN 'warning' END AS severity FROM w WHERE {e}"
        for n, (e, f, c) in FOUND.items()
    )
)
def detector_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.findings(lines(spark, sf_dir).selectExpr(*[f"{v} AS {k}" for k, v in FIGURES.items()]))


CURVE = """c AS (SELECT CAST((hour(ts) * 60 + minute(ts)) // 15 * 15 AS BIGINT) AS slot, round(quantile_cont(value, 0.1), 6) AS p10,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY ALL),
t AS (SELECT CAST((hour(ts) * 60 + minute(ts)) // 15 * 15 AS BIGINT) AS slot, arg_max(value, (ts, event_id)) AS value FROM events
  WHERE ts >= TIMESTAMP '2024-01-25' AND ts < TIMESTAMP '2024-01-26' GROUP BY ALL), b AS (SELECT * FROM c FULL JOIN t USING (slot))"""


@query(f"""WITH {CURVE}, o AS (SELECT coalesce(sum(greatest(0, value) * 0.25) FILTER (slot <= 720), 0) AS observed FROM b)
SELECT round(observed, 6) AS observed, round(sum(greatest(0, p50) * 0.25) FILTER (slot <= 720 AND p50 >= 25), 6) AS expected,
  round(observed + sum(greatest(0, p10) * 0.25) FILTER (slot > 720), 6) AS end_p10, round(observed + sum(greatest(0, p50) * 0.25) FILTER (slot > 720), 6) AS end_p50,
  round(observed + sum(greatest(0, p90) * 0.25) FILTER (slot > 720), 6) AS end_p90,
  round(count_if(slot <= 720 AND p50 >= 25 AND value IS NOT NULL) / count_if(slot <= 720 AND p50 >= 25), 6) AS coverage,
  count_if(p50 >= 25) AS productive_slots FROM b, o GROUP BY observed""")
def solar_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.samples(spark, sf_dir)
    day = F.to_date("observed_at")
    minute = F.hour("observed_at") * 60 + F.minute("observed_at")
    today = rows.where(day == F.lit("2024-01-25").cast("date")).groupBy((minute - minute % 15).cast("long").alias("slot")).agg(
        F.max_by("numeric_value", F.struct("observed_at", "sample_id")).alias("value")
    )
    curve = site.slot_curve(rows.where(F.col("observed_at") < F.lit("2024-01-25").cast("timestamp_ntz")))
    return outlook.solar_outlook(curve, today, [], 720)


@query(f"""WITH q AS ({SQL["backtest_errors"]}), r AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY day DESC) <= 14)
SELECT system_id, count(*) AS days, round(median(ape), 6) AS median_ape, round(avg(ape), 6) AS mean_ape, round(quantile_cont(ape, 0.9), 6) AS p90_ape
  FROM r GROUP BY ALL""")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlook.error_metrics(backtest_errors(spark, sf_dir), ["system_id"])


@query("""WITH d AS (SELECT user_id % 5 AS system_id, CAST(ts AS DATE) AS day, round(sum(value), 6) AS energy FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY day) AS i FROM d),
f AS (SELECT a.system_id, a.day, a.energy, quantile_cont(b.energy, 0.1) AS low, quantile_cont(b.energy, 0.9) AS high, count(*) AS past FROM n a JOIN n b ON a.system_id = b.system_id AND b.i < a.i AND b.i >= a.i - 28 GROUP BY ALL),
r AS (SELECT * FROM f WHERE past >= 5 QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY day DESC) <= 14)
SELECT system_id, count(*) AS days, round(count(*) FILTER (energy BETWEEN low AND high) / count(*), 6) AS coverage,
  CASE WHEN count(*) >= 5 THEN 'ready' ELSE 'insufficient_evidence' END AS status FROM r GROUP BY system_id""")
def backtest_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = lens.samples(spark, sf_dir).groupBy(F.expr("device_id % 5").alias("system_id"), F.to_date("observed_at").alias("day")).agg(
        F.round(F.sum("numeric_value"), 6).alias("energy")
    )
    return outlook.interval_coverage(site.walk_forward_bands(daily, ["system_id"]), ["system_id"])


#: orders as changes, a priority of the table as the kind of path; each change may bring a proposal.
PATH = "CASE o_orderkey % 4 WHEN 0 THEN 'catalog/registers.json' WHEN 1 THEN concat('proposals/p', o_orderkey, '.json') WHEN 2 THEN 'tests/test_x.py' ELSE 'docs/readme' END"
CONTENT = """CASE o_orderkey % 5 WHEN 0 THEN '{' WHEN 1 THEN '{"source_id": " ", "changes": []}'
  ELSE concat('{"source_id": "s", "source_sha256": "', sha256(CAST(o_orderkey AS {text})), '", "affected_profiles": ["p"], "changes": [1], "tests": ["t"]}') END"""


@query(f"""WITH c AS (SELECT DISTINCT o_custkey AS change_id, {PATH} AS path, o_orderkey % 4 AS kind, o_orderkey % 5 AS whole FROM orders),
w AS (SELECT change_id, path, kind, CASE WHEN kind = 1 THEN CASE whole WHEN 0 THEN ['invalid proposal JSON'] WHEN 1 THEN ['missing required key(s): affected_profiles, source_sha256, tests',
  'source_id must be non-empty', 'source_sha256 must be a 64-character SHA-256 digest', 'affected_profiles must be a non-empty list', 'changes must be a non-empty list', 'tests must be a non-empty list']
  WHEN 4 THEN ['invalid proposal JSON'] ELSE [] END ELSE [] END AS wrong FROM c),
g AS (SELECT change_id, max(kind = 0) AS touched, max(kind = 1) AS proposed, max(kind = 2) AS tested,
  list_sort(flatten(list(list_transform(wrong, lambda x: path || ': ' || x)))) AS wrong FROM w GROUP BY change_id)
SELECT change_id, CASE WHEN touched THEN array_to_string(list_concat(list_filter([CASE WHEN NOT proposed THEN 'changes of the catalog or its sources need a reviewed proposal' END,
  CASE WHEN NOT tested THEN 'changes of the catalog or its sources need a change of the tests' END], lambda x: x IS NOT NULL), wrong), '; ') ELSE '' END AS errors FROM g""")
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each change; proposals of some are not there."""
    rows = orders(spark, sf_dir)
    changes = rows.selectExpr("o_custkey AS change_id", f"{PATH} AS path").distinct()
    content = CONTENT.replace("sha256(CAST(o_orderkey AS {text}))", "sha2(CAST(o_orderkey AS STRING), 256)")
    proposals = rows.where("o_orderkey % 4 = 1 AND o_orderkey % 5 < 4").selectExpr(f"{PATH} AS path", f"{content} AS content")
    found = gates.review(changes, proposals, ("catalog/",), "proposals/", "tests/")
    return found.withColumn("errors", F.array_join("errors", "; "))


@query(f"""WITH q AS ({SQL["float_probability"]}) SELECT system_id % 2 AS site_id, min(probability) AS probability, max(median_minute) AS minute,
  count(*) AS controllers FROM q GROUP BY ALL""")
def site_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = float_probability(spark, sf_dir).withColumn("site_id", F.expr("system_id % 2"))
    return outlook.site_charge(rows, ["site_id"])


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_quantity END AS system_kwh,
  CASE WHEN l_linenumber < 4 THEN l_extendedprice END AS daily_wh, CASE WHEN l_linenumber < 6 THEN l_quantity END AS daily_kwh FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(system_kwh * 1000, daily_wh, daily_kwh * 1000) AS wh, CASE WHEN system_kwh IS NOT NULL THEN 'system_kwh'
  WHEN daily_wh IS NOT NULL THEN 'daily_wh' WHEN daily_kwh IS NOT NULL THEN 'daily_kwh' ELSE 'unknown' END AS provenance FROM r""")
def ledger_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = lines(spark, sf_dir).select(
        "l_orderkey",
        n,
        F.when(n == 1, F.col("l_quantity")).alias("system_kwh"),
        F.when(n < 4, F.col("l_extendedprice")).alias("daily_wh"),
        F.when(n < 6, F.col("l_quantity")).alias("daily_kwh"),
    )
    return outlook.ledger(rows).select("l_orderkey", "l_linenumber", "wh", "provenance")


@query("""WITH k AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type || ':' || user_id END AS dedupe_key FROM events),
i AS (SELECT dedupe_key, arg_min(event_id, (ts, event_id)) AS event_id FROM k WHERE ts >= TIMESTAMP '2024-01-15' AND dedupe_key IS NOT NULL GROUP BY ALL)
SELECT dedupe_key, event_id FROM i WHERE dedupe_key NOT IN (SELECT dedupe_key FROM k WHERE ts < TIMESTAMP '2024-01-15' AND dedupe_key IS NOT NULL)
UNION ALL SELECT dedupe_key, event_id FROM k WHERE ts >= TIMESTAMP '2024-01-15' AND dedupe_key IS NULL""")
def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_type <> 'error' THEN event_type || ':' || user_id END AS dedupe_key", "event_id", "ts"
    )
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    return archive.append_new(rows.where(F.col("ts") < middle), rows.where(F.col("ts") >= middle), "dedupe_key", ["ts", "event_id"]).drop("ts")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL")
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.manifest(lens.samples(spark, sf_dir)).drop("digest")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7919) % 65536 AS w0, (l_suppkey * 104729 + l_linenumber) % 65536 AS w1 FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, [65535, w0 >> 8, w0 & 255, w1 >> 8, w1 & 255] AS bytes FROM w)
SELECT l_orderkey, l_linenumber, CAST(list_reduce(bytes, lambda crc, byte: list_reduce([xor(crc, byte), 1, 2, 3, 4, 5, 6, 7, 8],
  lambda x, turn: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 40961) ELSE x >> 1 END)) AS INTEGER) AS crc FROM b""")
def frame_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = frames.word_bytes(F.col("w0"), F.col("w1"))
    return lens.words(spark, sf_dir).select("l_orderkey", "l_linenumber", frames.crc16(data).alias("crc"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, with the columns of samples; a stream reads a single file only by a pattern."""
    schema = lens.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").selectExpr(
        "event_id AS sample_id", "user_id AS device_id", "ts AS observed_at", "event_type AS register_name", "value AS numeric_value", "event_type AS state"
    )


def shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams"


@query(f"""WITH {E}, {CHANGES} SELECT device_id, observed_at, sample_id, state, previous FROM c WHERE changed = 1""")
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drain(spark, live.changes(streamed(spark, sf_dir), ["device_id"]), shared(spark))


@query(KEPT)
def stream_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drain(spark, live.rate_limited(streamed(spark, sf_dir), ["device_id"], 12 * 3600), shared(spark))
