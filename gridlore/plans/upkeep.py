"""Queries that run over stored and streamed data: upkeep, appended polls, incidents and life cycles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.plans.fleet import shared
from gridlore.plans.telemetry import E, query
from gridlore.sources import lens, maintain
from gridlore.sources.shared import shared_path
from gridlore.streaming import keyed, live, sink

CUT = "TIMESTAMP '2024-01-20'"


@query(f"""WITH {E}, n AS (SELECT device_id, register_name, 'numeric' AS kind, sec // 10 * 10 AS bucket_start, count(*) AS n, min(numeric_value) AS low,
  max(numeric_value) AS high, round(avg(numeric_value), 6) AS mean, CAST(NULL AS BIGINT) AS transitions FROM e WHERE observed_at < {CUT} AND numeric_value IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY device_id, register_name ORDER BY observed_at, sample_id) <> state THEN 1 ELSE 0 END AS turn FROM e WHERE state IS NOT NULL)
SELECT * FROM n UNION ALL SELECT device_id, register_name, 'state', sec // 10 * 10 AS b, count(*), NULL, NULL, NULL, CAST(sum(turn) AS BIGINT)
  FROM s WHERE observed_at < {CUT} GROUP BY device_id, register_name, b""")
def maintained_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten-second tier after two runs of the upkeep, the second over rows that came late."""
    root = shared_path(spark, "upkeep")
    rows = lens.samples(spark, sf_dir).select("sample_id", "device_id", "observed_at", "register_name", "numeric_value", "state")
    tiers = {"warm": (1, 10), "cool": (10, 60)}
    for late in (F.col("sample_id") % 7 != 0, F.col("sample_id") % 7 == 0):
        maintain.append_raw(rows.where(late), root)
        maintain.maintain(spark, root, date(2024, 1, 21), tiers, files_a_day=1)
    return maintain.tier_rows(spark, root, "warm").select("device_id", "register_name", "kind", "bucket_start", "n", "low", "high", "mean", "transitions")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; a stream reads a single file only by a pattern."""
    schema = lens.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


@query("""WITH p AS (SELECT user_id AS device_id, event_id AS id, ts AS seen, event_type = 'error' AS bad, value, event_type FROM events)
SELECT device_id, CASE WHEN arg_max(bad, (seen, id)) THEN 'error' ELSE 'online' END AS status, max(seen) FILTER (NOT bad) AS last_seen,
  CASE WHEN arg_max(bad, (seen, id)) THEN 1000 END AS error_chars, count(*) FILTER (NOT bad) AS n_samples, count(*) FILTER (bad) AS n_errors,
  round(coalesce(sum(value) FILTER (NOT bad), 0), 4) AS total, count(*) FILTER (event_type = 'click') AS n_true FROM p GROUP BY device_id""")
def appended_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices after all polls were appended by a stream, from what the three tables hold."""
    root = shared_path(spark, "polls")
    polls = stream_of(spark, sf_dir, "events").selectExpr(
        "event_id AS sample_id",
        "user_id AS device_id",
        "ts AS observed_at",
        "value AS latency_ms",
        "'p' AS profile",
        "CASE WHEN event_type = 'error' THEN repeat('no reply. ', 150) END AS error",
        """array(struct('value' AS name, 1 AS address, 'holding' AS function, array(1, 2) AS raw, CASE WHEN NOT isnan(value) THEN value END AS number,
             CAST(NULL AS BOOLEAN) AS flag, CAST(NULL AS STRING) AS text, 'A' AS unit),
           struct('click' AS name, 2 AS address, 'coil' AS function, array(0) AS raw, CAST(NULL AS DOUBLE) AS number, event_type = 'click' AS flag,
             CAST(NULL AS STRING) AS text, CAST(NULL AS STRING) AS unit)) AS values""",
    )
    sink.append_polls(polls, root).awaitTermination()
    samples, values, errors = (sink.appended(spark, root, n) for n in sink.TABLES)
    of_device = values.join(samples.select("sample_id", "device_id"), "sample_id").groupBy("device_id").agg(
        F.round(F.sum("numeric_value"), 4).alias("total"), F.count_if(F.col("text_value") == "True").alias("n_true")
    )
    counts = samples.groupBy("device_id").agg(F.count("*").alias("n_samples"))
    failed = errors.groupBy("device_id").agg(F.count("*").alias("n_errors"))
    status = sink.device_status(samples, errors)
    joined = status.join(counts, "device_id", "left").join(failed, "device_id", "left").join(of_device, "device_id", "left")
    return joined.select("device_id", "status", "last_seen", F.length("last_error").alias("error_chars"), "n_samples", "n_errors", "total", "n_true").na.fill(0, ["n_samples", "n_errors", "total", "n_true"])


@query("""WITH e AS (SELECT user_id, event_id, ts, unnest(['high', 'third']) AS fingerprint, event_type, value FROM events),
p AS (SELECT *, CASE fingerprint WHEN 'high' THEN coalesce(value > 20, false) ELSE event_id % 3 = 0 END AS present,
  CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity, CAST(event_id % 2 AS VARCHAR) AS title FROM e),
l AS (SELECT *, coalesce(lag(present) OVER w, false) AS had, lag(severity) OVER w AS s, lag(title) OVER w AS t FROM p WINDOW w AS (PARTITION BY user_id, fingerprint ORDER BY ts, event_id)),
o AS (SELECT *, CASE WHEN present AND NOT had THEN 'opened' WHEN present AND (severity <> s OR title <> t) THEN 'updated' WHEN had AND NOT present THEN 'resolved' END AS transition,
  count(*) FILTER (present AND NOT had) OVER (PARTITION BY user_id, fingerprint ORDER BY ts, event_id) AS g FROM l),
c AS (SELECT *, count(*) FILTER (present) OVER (PARTITION BY user_id, fingerprint, g ORDER BY ts, event_id) AS n FROM o)
SELECT user_id // 30 AS system_uid, user_id AS evaluation_key, fingerprint, event_id AS scan_id, transition, CASE WHEN transition = 'resolved' THEN s ELSE severity END AS severity,
  n AS occurrences FROM c WHERE transition IS NOT NULL""")
def stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    finding = "struct('{n}' AS fingerprint, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity, CAST(0.5 AS DOUBLE) AS confidence, CAST(event_id % 2 AS STRING) AS title, CAST(NULL AS STRING) AS summary)"
    scans = stream_of(spark, sf_dir, "events").selectExpr(
        "user_id div 30 AS system_uid",
        "user_id AS evaluation_key",
        "ts AS scan_at",
        "event_id AS scan_id",
        f"filter(array(CASE WHEN value > 20 AND NOT isnan(value) THEN {finding.format(n='high')} END, CASE WHEN event_id % 3 = 0 THEN {finding.format(n='third')} END), x -> x IS NOT NULL) AS findings",
    )
    return live.drain(spark, keyed.incidents(scans, ["system_uid", "evaluation_key"]), shared(spark))


LIVES = """WITH RECURSIVE k AS (SELECT user_id AS device_id, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'click' THEN 'success'
  WHEN event_id % 5 = 0 THEN 'moved' WHEN event_id % 5 = 1 THEN 'missing' WHEN event_id % 5 = 2 THEN 'connecting' WHEN event_id % 5 = 3 THEN 'failure' ELSE 'discovered' END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 'discovered' AS state, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS reconnects,
  CAST(0 AS BIGINT) AS moves, CAST(NULL AS BIGINT) AS since, CAST(0 AS DOUBLE) AS retry_s FROM k
UNION ALL
SELECT f.device_id, k.n, k.event_id, CASE WHEN kind IN ('moved', 'discovered') THEN CASE WHEN state IN ('offline', 'rediscovering') THEN 'connecting' WHEN state = 'online' THEN state ELSE 'discovered' END
    WHEN kind = 'missing' THEN CASE WHEN state = 'offline' THEN state ELSE 'rediscovering' END WHEN kind = 'connecting' THEN CASE WHEN state = 'online' THEN state ELSE 'connecting' END
    WHEN kind = 'success' THEN 'online' WHEN failures + 1 >= 2 THEN 'offline' ELSE 'degraded' END,
  CASE kind WHEN 'success' THEN 0 WHEN 'failure' THEN failures + 1 ELSE failures END,
  reconnects + CASE WHEN kind = 'success' AND (state IN ('offline', 'rediscovering', 'degraded') OR failures > 0) THEN 1 ELSE 0 END, moves + CASE WHEN kind = 'moved' THEN 1 ELSE 0 END,
  CASE WHEN kind = 'success' THEN NULL WHEN kind = 'missing' OR (kind = 'failure' AND failures + 1 >= 2) THEN coalesce(since, ms) ELSE since END,
  CASE WHEN kind IN ('moved', 'discovered', 'success') THEN 0 WHEN kind = 'failure' THEN least(60.0, pow(2.0, failures)) ELSE retry_s END
FROM f JOIN k ON k.device_id = f.device_id AND k.n = f.n + 1)
SELECT device_id, event_id, state, failures, reconnects, moves, since AS offline_since_ms, retry_s FROM f WHERE n > 0"""


@query(LIVES)
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_of(spark, sf_dir, "events").selectExpr(
        "user_id AS device_id",
        "event_id",
        "ts AS observed_at",
        """CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'click' THEN 'success' ELSE
           element_at(array('moved', 'missing', 'connecting', 'failure', 'discovered'), CAST(event_id % 5 AS INT) + 1) END AS kind""",
    )
    return live.drain(spark, keyed.lifecycle(events, ["device_id"], threshold=2), shared(spark))
