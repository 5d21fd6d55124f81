"""Queries on the register catalog; its frames stand in nation, whose size is fixed, so the catalog does not grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlore.operators import catalog
from gridlore.plans import docscan, evidence, identity, series, timeline, upkeep  # noqa: F401  register their queries
from gridlore.plans.fleet import QUERIES, SQL
from gridlore.plans.telemetry import query
from gridlore.sources import lens

__all__ = ["QUERIES", "SQL"]


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS BIGINT) AS device_id",
        "CAST(c_nationkey % 5 AS BIGINT) AS profile",
        "concat('v', c_custkey % 30) AS firmware",
        "CASE WHEN c_acctbal < 0 THEN 'generic' ELSE 'verified' END AS status",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_regionkey AS BIGINT) AS profile",
        "'holding' AS function",
        "CAST(n_nationkey * 4 AS BIGINT) AS address",
        "CAST(1 + n_nationkey % 2 AS BIGINT) AS count",
        "CASE WHEN n_nationkey % 5 = 1 THEN 'metadata' ELSE 'runtime' END AS category",
        "n_nationkey % 3 = 0 AS optional",
        "CAST(n_nationkey AS STRING) AS since_firmware",
        "CAST(NULL AS STRING) AS until_firmware",
    )


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = lens.table(spark, sf_dir, "nation")
    registers = nation.selectExpr("CAST(n_regionkey AS BIGINT) AS profile", "n_name AS name", "CAST(n_nationkey * 5 AS BIGINT) AS address", "CAST(2 AS BIGINT) AS words")
    observed = lens.table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey % 7 AS BIGINT) AS source_id",
        "CAST(l_partkey % 130 AS BIGINT) AS address",
        "l_returnflag AS label",
        "CASE l_linenumber WHEN 1 THEN 'reserved' WHEN 2 THEN 'eeprom' ELSE 'runtime' END AS scope",
        "l_discount * 10 AS confidence",
    )
    profiles = lens.table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS profile", "CAST(r_regionkey AS BIGINT) AS source_id")
    return catalog.compared(observed, profiles, registers, blocks(spark, sf_dir))


@query("""SELECT CAST(c_custkey AS BIGINT) AS device_id, CAST(n_nationkey * 4 AS BIGINT) AS address, CAST(1 + n_nationkey % 2 AS BIGINT) AS words
  FROM customer JOIN nation ON n_regionkey = c_nationkey % 5 WHERE c_custkey % 30 >= n_nationkey""")
def effective_register_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.effective(devices(spark, sf_dir), blocks(spark, sf_dir)).selectExpr("device_id", "address", "count AS words")


@query("""WITH b AS (SELECT c_custkey, n_nationkey, 1 + n_nationkey % 2 AS n, n_nationkey % 3 = 0 AS optional, n_nationkey % 5 = 1 AS meta
  FROM customer JOIN nation ON n_regionkey = c_nationkey % 5 WHERE c_custkey % 30 >= n_nationkey),
s AS (SELECT DISTINCT o_custkey, o_orderkey % 100 AS a FROM orders),
r AS (SELECT c_custkey, n_nationkey, optional, meta, count(a) = n AS readable FROM b LEFT JOIN s ON o_custkey = c_custkey
  AND a >= n_nationkey * 4 AND a < n_nationkey * 4 + n GROUP BY c_custkey, n_nationkey, optional, meta, n)
SELECT CAST(c.c_custkey AS BIGINT) AS device_id, count(*) FILTER (NOT meta AND readable) AS runtime_readable, count(*) FILTER (NOT meta) AS runtime_total,
  count(*) FILTER (meta AND readable) AS metadata_readable, count(*) FILTER (meta) AS metadata_total, count(*) FILTER (optional AND readable) AS optional_readable,
  count(*) FILTER (optional) AS optional_total, CASE WHEN count(*) FILTER (NOT optional AND NOT readable) = 0 AND any_value(c_acctbal) >= 0 THEN 'verified' ELSE 'failed' END AS result
  FROM customer c LEFT JOIN r ON r.c_custkey = c.c_custkey GROUP BY c.c_custkey""")
def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lens.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey AS BIGINT) AS device_id", "'holding' AS function", "CAST(o_orderkey % 100 AS BIGINT) AS address"
    )
    own = devices(spark, sf_dir)
    found = catalog.readable_blocks(catalog.effective(own, blocks(spark, sf_dir)).drop("status"), words)
    return catalog.verification(own.select("device_id", "status"), found).drop("status")


COMPARED = """o AS (SELECT l_suppkey % 7 AS source, l_partkey % 130 AS a, l_returnflag AS label, l_linenumber AS k, l_discount * 10 AS confidence FROM lineitem),
m AS (SELECT o.*, r_regionkey AS profile, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = source AND a - n_nationkey * 5 BETWEEN 0 AND 1) AS named,
  EXISTS (SELECT 1 FROM nation WHERE n_regionkey = source AND a - n_nationkey * 4 BETWEEN 0 AND n_nationkey % 2) AS in_block
  FROM o LEFT JOIN region ON r_regionkey = source),
x AS (SELECT *, CASE WHEN profile IS NULL THEN 'unmapped_source' WHEN k = 1 AND named THEN NULL WHEN k = 1 THEN 'reserved' WHEN k = 2 THEN 'eeprom'
  WHEN named THEN 'covered_named_register' END AS reason, CASE WHEN k = 1 THEN 'declared_register_overlaps_reserved_vendor_row'
  WHEN in_block THEN 'unnamed_field_in_read_block' ELSE 'runtime_address_outside_read_blocks' END AS change_type,
  CASE WHEN k = 1 THEN 0.95::DOUBLE WHEN in_block THEN least(confidence, 0.7::DOUBLE) ELSE least(confidence, 0.9::DOUBLE) END AS sure FROM m)"""


@query(f"""WITH {COMPARED} SELECT CAST(profile AS BIGINT) AS profile, change_type, CAST(a AS BIGINT) AS address, label, max(sure) AS confidence,
  change_type LIKE 'declared%' AS actionable FROM x WHERE reason IS NULL GROUP BY ALL""")
def catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.proposed_changes(comparison(spark, sf_dir)).drop("declared_names")


@query(f"WITH {COMPARED} SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY ALL")
def catalog_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ignored_counts(comparison(spark, sf_dir))


@query("""WITH v AS (SELECT l_suppkey AS site_id, CAST(l_partkey % 12 AS DOUBLE) AS i, min(l_discount) > 0 AS passed FROM lineitem GROUP BY ALL),
f AS (SELECT site_id, max(i) FILTER (NOT passed) AS stopped_at FROM v GROUP BY ALL)
SELECT site_id, stopped_at, coalesce(min(i) FILTER (stopped_at IS NULL OR i > stopped_at), CAST(60 AS DOUBLE)) AS interval_s
  FROM v JOIN f USING (site_id) GROUP BY ALL""")
def tuned_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = lens.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS site_id", "CAST(l_partkey % 12 AS DOUBLE) AS interval_s", "l_discount > 0 AS passed")
    return catalog.tuned_interval(verdicts, ["site_id"], 60.0)
