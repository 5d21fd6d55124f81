"""Queries on the identity of controllers, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.operators import identity
from gridlore.plans.telemetry import query
from gridlore.sources import lens
from gridlore.sources.shared import materialise

#: events as discovery observations: users of one group share serial numbers and adapters, errors name nothing but their endpoint.
SEEN = {
    "sample_id": "event_id",
    "observed_at": "ts",
    "profile": "CASE WHEN event_id % 17 = 0 THEN 'B' ELSE ' a' END",
    "serial": "CASE WHEN event_type = 'click' THEN concat('SN', user_id - user_id % 3 + event_id % 2) WHEN event_id % 11 = 0 THEN ' ' END",
    "usb_serial": "CASE WHEN event_type = 'view' OR event_type = 'click' THEN concat('U', user_id - user_id % 3) ELSE '' END",
    "unit": "event_id % 2",
    "endpoint": "concat('tcp:', user_id)",
    "device_id": "CASE WHEN user_id % 4 = 0 THEN concat('dev', user_id) END",
}
MATCHED = """WITH RECURSIVE s AS (SELECT {seen}, user_id // 3 AS g FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY observed_at, sample_id) AS n, lower(trim(profile)) AS p, coalesce(trim(serial), '') AS sn,
  coalesce(device_id, endpoint) AS device, CASE WHEN trim(serial) <> '' THEN 'controller_serial' WHEN trim(usb_serial) <> '' THEN 'usb_serial' ELSE 'endpoint' END AS source,
  CASE WHEN trim(serial) <> '' THEN 'serial:' || lower(trim(profile)) || ':' || lower(trim(serial)) WHEN trim(usb_serial) <> ''
    THEN 'usb:' || lower(trim(usb_serial)) || ':unit:' || unit ELSE 'endpoint:' || endpoint END AS k FROM s),
f AS (SELECT g, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS sample_id, CAST(NULL AS VARCHAR) AS c, CAST(NULL AS VARCHAR) AS d, CAST(NULL AS VARCHAR) AS how,
  CAST(NULL AS DOUBLE) AS sure, CAST(MAP {{}} AS MAP(VARCHAR, STRUCT(d VARCHAR, sn VARCHAR))) AS ids, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS own
  FROM (SELECT DISTINCT g FROM o)
UNION ALL
SELECT g, n, sample_id, c, d, how, CASE how WHEN 'controller_serial' THEN 1.0 WHEN 'controller_serial_conflict' THEN 0.95 WHEN 'controller_serial_promotion' THEN 1.0
    WHEN 'known_endpoint_owner' THEN CASE WHEN was.sn <> '' THEN 0.95 ELSE 0.65 END WHEN 'new_controller' THEN 0.4 ELSE 0.8 END,
  map_concat(CASE WHEN how = 'controller_serial_promotion' THEN map_from_entries(list_filter(map_entries(ids), lambda x: x.key <> owner)) ELSE ids END,
    MAP {{c: {{'d': d, 'sn': CASE WHEN sn <> '' THEN sn ELSE coalesce(ids[c].sn, '') END}}}}),
  map_concat(CASE WHEN how = 'controller_serial_promotion' THEN map_from_entries(list_transform(map_entries(own), lambda x: {{'k': x.key,
    'v': CASE WHEN x.value = owner THEN c ELSE x.value END}})) ELSE own END, MAP {{endpoint: c}})
FROM (SELECT *, CASE WHEN how = 'known_endpoint_owner' THEN owner ELSE k END AS c, CASE how WHEN 'controller_serial_conflict'
    THEN 'device:' || trim(profile) || ':' || substr(sha256(trim(profile) || chr(0) || sn || chr(0) || endpoint), 1, 20) WHEN 'new_controller' THEN device
    WHEN 'controller_serial_promotion' THEN was.d WHEN 'known_endpoint_owner' THEN was.d ELSE ids[k].d END AS d
  FROM (SELECT *, CASE WHEN ids[k] IS NOT NULL THEN source WHEN owner IS NULL THEN 'new_controller' WHEN sn <> '' AND was.sn = '' THEN 'controller_serial_promotion'
      WHEN sn <> '' AND sn <> was.sn THEN 'controller_serial_conflict' ELSE 'known_endpoint_owner' END AS how
    FROM (SELECT o.*, ids, own, own[o.endpoint] AS owner, ids[own[o.endpoint]] AS was FROM f JOIN o ON o.g = f.g AND o.n = f.n + 1))))
SELECT sample_id, c AS controller_id, d AS canonical_device_id, how AS match_strategy, sure AS match_confidence FROM f WHERE n > 0"""


@query(MATCHED.format(seen=", ".join(f"{v} AS {k}" for k, v in SEEN.items())))
def registration_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.table(spark, sf_dir, "events").selectExpr(*[f"{v} AS {k}" for k, v in SEEN.items()])
    return identity.registrations(rows).drop("observed_at", "endpoint")


#: orders as identities: ids of a group of thirty share devices, now and then two of them.
SNAPSHOTS = """SELECT concat('c', o_custkey) AS controller_id, concat('d', (o_custkey - o_custkey % 30) + ((o_custkey % 30 + o_orderkey % 2 * (o_custkey % 7)) {div} 4)) AS canonical_device_id,
  o_orderdate AS first_seen, o_orderdate AS last_seen FROM orders"""
PHYSICAL = f"""s AS ({SNAPSHOTS.format(div="//")}), e AS (SELECT DISTINCT controller_id AS c, canonical_device_id AS d FROM s),
r AS (SELECT c, c AS other FROM e UNION SELECT r.c, b.c FROM r JOIN e a ON a.c = r.other JOIN e b ON b.d = a.d),
g AS (SELECT c, min(other) AS component FROM r GROUP BY c), p AS (SELECT g.component, s.* FROM s JOIN g ON g.c = s.controller_id),
d AS (SELECT component, canonical_device_id, min(first_seen) AS first_seen FROM p GROUP BY ALL),
u AS (SELECT component, 'ctrl_' || md5(arg_min(canonical_device_id, (first_seen, canonical_device_id))) AS controller_uid FROM d GROUP BY ALL),
ids AS (SELECT component, controller_id, canonical_device_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM p GROUP BY ALL),
w AS (SELECT component, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max((last_seen, controller_id, canonical_device_id)) AS now FROM ids GROUP BY ALL),
a AS (SELECT component, controller_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM ids GROUP BY ALL)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens.table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(SNAPSHOTS.format(div="div"))


@query(f"""WITH RECURSIVE {PHYSICAL} SELECT controller_uid, now[3] AS canonical_device_id, now[2] AS current_controller_id, first_seen, last_seen
  FROM w JOIN u USING (component)""")
def physical_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.physical(snapshots(spark, sf_dir))[0]


@query(f"""WITH RECURSIVE {PHYSICAL} SELECT a.controller_id, controller_uid, a.first_seen, a.last_seen, a.controller_id = now[2] AS active
  FROM a JOIN u USING (component) JOIN w USING (component)""")
def controller_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.physical(snapshots(spark, sf_dir))[1]


@query(f"""WITH RECURSIVE {PHYSICAL}, m AS (SELECT controller_id, canonical_device_id || '.' || x AS device_id, min(last_seen) AS last_seen
  FROM s, (VALUES ('0'), ('1')) t(x) WHERE month(last_seen) % 2 = CAST(x AS INT) GROUP BY ALL),
l AS (SELECT controller_id, list(device_id ORDER BY last_seen, device_id) AS devices FROM m GROUP BY ALL)
SELECT i.controller_id AS identifier, controller_uid, now[2] AS controller_id, now[3] AS canonical_device_id,
  array_to_string(list_append(coalesce(devices, []), now[3]), ',') AS history_device_ids
  FROM (SELECT DISTINCT controller_id FROM s) i JOIN a USING (controller_id) JOIN u USING (component) JOIN w USING (component) LEFT JOIN l ON l.controller_id = now[2]""")
def controller_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir)
    members = rows.selectExpr("controller_id", "concat(canonical_device_id, '.', month(last_seen) % 2) AS device_id", "last_seen")
    controllers, aliases = (materialise(df) for df in identity.physical(rows))
    found = identity.scopes(rows.selectExpr("controller_id AS identifier"), controllers, aliases, members)
    return found.withColumn("history_device_ids", F.array_join("history_device_ids", ","))


#: customer as promotions, in chains: half of an id is the stronger one, but those divisible by five stay.
MOVES = "SELECT CAST(c_custkey AS BIGINT) AS old, CAST(c_custkey {div} 2 AS BIGINT) AS new FROM customer WHERE c_custkey % 5 <> 0"
DEPENDENT = {
    "members": "SELECT CAST(o_custkey AS BIGINT) AS controller_id, concat('m', o_orderkey % 7) AS name, o_orderdate AS seen, CAST(1 + o_orderkey % 3 AS BIGINT) AS n, o_totalprice AS sure FROM orders",
    "connections": "SELECT CAST(l_suppkey AS BIGINT) AS controller_id, concat(l_returnflag, l_linestatus) AS name, l_shipdate AS seen, CAST(l_linenumber AS BIGINT) AS n, l_tax AS sure FROM lineitem",
}


@query(f"""WITH RECURSIVE m AS ({MOVES.format(div="//")}), c AS (SELECT old, new FROM m UNION ALL SELECT c.old, m.new FROM c JOIN m ON m.old = c.new),
r AS (SELECT old, min(new) AS new FROM c GROUP BY old),
t AS ({" UNION ALL ".join(f"SELECT '{n}' AS table_name, * FROM ({s})" for n, s in DEPENDENT.items())})
SELECT table_name, coalesce(new, controller_id) AS controller_id, name, min(seen) AS first_seen, max(seen) AS last_seen, CAST(sum(n) AS BIGINT) AS observations, max(sure) AS confidence
  FROM t LEFT JOIN r ON old = controller_id GROUP BY ALL""")
def promoted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("customer", "orders", "lineitem"):
        lens.table(spark, sf_dir, name).createOrReplaceTempView(name)
    moves = identity.settled(spark.sql(MOVES.format(div="div")))
    out = None
    for name, text in DEPENDENT.items():
        counted = spark.sql(text).selectExpr("controller_id", "name", "seen AS first_seen", "seen AS last_seen", "n AS observations", "sure AS confidence")
        one = identity.merged_counters(identity.rekeyed(counted, moves), ["controller_id", "name"]).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


LEGACY = {
    "device_id": "concat('dev', c_custkey)",
    "profile": "'p'",
    "serial": "CASE WHEN c_custkey % 3 = 0 THEN concat('SN', c_custkey % 50) ELSE ' ' END",
    "usb_serial": "CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END",
    "unit": "c_nationkey",
    "endpoint": "c_name",
    "status": "CASE c_custkey % 4 WHEN 0 THEN 'Online' WHEN 1 THEN 'error' WHEN 2 THEN 'offline' END",
    "first_seen": "CASE WHEN c_custkey % 5 > 0 THEN o_orderdate END",
    "last_seen": "o_orderdate",
}
LEGACY_ROWS = "SELECT c.*, o.o_orderdate FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey"


@query(f"""WITH d AS (SELECT {", ".join(f"{v} AS {k}" for k, v in LEGACY.items())} FROM ({LEGACY_ROWS})),
i AS (SELECT *, CASE WHEN trim(serial) <> '' THEN 'serial:p:' || lower(trim(serial)) WHEN usb_serial IS NOT NULL THEN 'usb:' || lower(usb_serial) || ':unit:' || unit
  ELSE 'endpoint:' || endpoint END AS controller_id, CASE WHEN trim(serial) <> '' THEN 'controller_serial' WHEN usb_serial IS NOT NULL THEN 'usb_serial' ELSE 'endpoint' END AS identity_source,
  CASE WHEN trim(serial) <> '' THEN trim(serial) ELSE coalesce(usb_serial, endpoint) END AS identity_value FROM d)
SELECT controller_id, first_value(device_id) OVER w AS canonical_device_id, identity_source, identity_value, device_id,
  coalesce(min(first_seen) OVER g, max(last_seen) OVER g) AS first_seen, last_seen,
  row_number() OVER w = 1 AND coalesce(lower(status) IN ('online', 'error') AND last_seen >= TIMESTAMP '1998-06-01', false) AS active
  FROM i WINDOW w AS (PARTITION BY controller_id ORDER BY last_seen DESC NULLS LAST, device_id DESC), g AS (PARTITION BY controller_id)""")
def legacy_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("customer", "orders"):
        lens.table(spark, sf_dir, name).createOrReplaceTempView(name)
    devices = spark.sql(LEGACY_ROWS).selectExpr(*[f"{v} AS {k}" for k, v in LEGACY.items()])
    return identity.bootstrap(devices, F.lit("1998-08-01").cast("timestamp_ntz"), 61 * 86400)


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS controller_id, concat(l_returnflag, l_linestatus) AS endpoint, month(l_shipdate) AS cycle, l_linenumber FROM lineitem),
k AS (SELECT DISTINCT controller_id, endpoint FROM c), s AS (SELECT DISTINCT controller_id, endpoint FROM c WHERE l_linenumber = 1 AND cycle = (SELECT max(cycle) FROM c WHERE l_linenumber = 1))
SELECT controller_id, endpoint, EXISTS (SELECT 1 FROM s WHERE s.controller_id = k.controller_id AND s.endpoint = k.endpoint) AS active FROM k""")
def presence_after_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS controller_id", "concat(l_returnflag, l_linestatus) AS endpoint", "month(l_shipdate) AS cycle", "l_linenumber")
    return identity.presence(rows.select("controller_id", "endpoint").distinct(), rows.where("l_linenumber = 1"))
