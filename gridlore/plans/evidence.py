"""Queries on what is known of devices, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.operators import evidence
from gridlore.plans.telemetry import query
from gridlore.sources import lens

#: lineitem as words of a supplier's registers: a part's number gives the address, the range of words depends on the supplier.
ADDRESS = "CASE l_partkey % 8 WHEN 6 THEN 26 + l_orderkey % 2 WHEN 7 THEN 262 + l_orderkey % 6 ELSE CASE WHEN l_partkey % 8 < 4 THEN 3 + l_partkey % 4 ELSE 13 + l_partkey % 2 END END"
WORD = """CASE l_suppkey % 5 WHEN 0 THEN CASE l_partkey % 8 WHEN 0 THEN 5000 WHEN 1 THEN 1200 WHEN 2 THEN 1100 WHEN 3 THEN 50 ELSE 7 END
  WHEN 1 THEN CASE WHEN l_partkey % 8 = 5 THEN 60 WHEN l_partkey % 8 = 4 THEN 120 ELSE 50 END WHEN 2 THEN CASE WHEN l_partkey % 8 = 7 THEN 3 ELSE 9 END
  WHEN 3 THEN CASE WHEN l_partkey % 8 = 7 THEN 300 ELSE 2 END ELSE 999 END"""


def probe(address: int, size: int) -> str:
    return " AND ".join(f"w[{address + n}] IS NOT NULL" for n in range(size))


@query(f"""WITH v AS (SELECT l_suppkey AS device_id, {ADDRESS} AS a, max({WORD}) AS word FROM lineitem GROUP BY ALL),
m AS (SELECT device_id, map_from_entries(list((a, word))) AS w FROM v GROUP BY ALL)
SELECT device_id, CASE WHEN {probe(3, 4)} AND w[3] BETWEEN 1000 AND 30000 AND w[4] BETWEEN 1000 AND 6000 AND w[5] BETWEEN 900 AND 2600 AND w[6] BETWEEN 45 AND 65 THEN 'inverter_gen2'
  WHEN {probe(13, 2)} AND w[13] BETWEEN 90 AND 260 AND w[14] BETWEEN 45 AND 65 THEN 'inverter_classic'
  WHEN {probe(262, 6)} AND w[264] IN (1, 3, 4) AND w[266] <= 255 THEN 'dual_controller'
  WHEN {probe(26, 2)} AND w[26] IN (0, 1, 2, 3) AND w[27] BETWEEN 0 AND 8 THEN 'pwm_controller' ELSE 'generic' END AS profile FROM m""")
def profile_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lens.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS device_id", f"{ADDRESS} AS address", f"{WORD} AS word")
    return evidence.fingerprint(words, ["device_id"])


#: customer as devices.
KNOWN = {
    "profile": "CASE WHEN c_custkey % 7 = 0 THEN 'generic' ELSE concat('p', c_nationkey % 3) END",
    "by_product": "c_custkey % 2 = 0",
    "vendor_matched": "c_acctbal > 0",
    "firmware": "CASE WHEN c_custkey % 3 > 0 THEN concat('v', c_custkey % 9, '.', c_nationkey) ELSE ' ' END",
    "serial": "CASE WHEN c_custkey % 5 > 1 THEN c_name END",
    "firmware_verified_max": "CASE WHEN c_nationkey % 3 > 0 THEN '6.10' END",
    "transport": "CASE c_custkey % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'serial' END",
    "metadata_error": "CASE WHEN c_custkey % 4 = 3 THEN 'Timeout' END",
}
HAS = "CASE c_custkey % 4 WHEN 0 THEN 'soc' WHEN 1 THEN 'generator_state' WHEN 2 THEN 'model' END"
VERSION = "list_transform(regexp_extract_all({}, '[0-9]+'), lambda x: CAST(x AS INT))"
DEVICES = f"""d AS (SELECT c_custkey AS device_id, {", ".join(f"{v} AS {k}" for k, v in KNOWN.items())}, {HAS} AS register FROM customer),
n AS (SELECT *, profile <> 'generic' AS known, trim(firmware) <> '' AND firmware_verified_max IS NOT NULL AND {VERSION.format("firmware")} > {VERSION.format("firmware_verified_max")} AS beyond FROM d)"""


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.table(spark, sf_dir, "customer")
    return rows.selectExpr(
        "c_custkey AS device_id",
        *[f"{v} AS {k}" for k, v in KNOWN.items()],
        f"CASE WHEN {HAS} IS NOT NULL THEN map({HAS}, '1') END AS metadata",
        "array('history', 'alarms') AS declared",
    )


def told(df: DataFrame) -> DataFrame:
    """Lists as texts."""
    codes = lambda c: F.array_join(F.transform(c, lambda e: e["code"]), ",").alias(c)
    return df.select("device_id", "profile", F.round("confidence", 6).alias("confidence"), "status", F.array_join("capabilities", ",").alias("capabilities"), codes("evidence"), codes("warnings"))


SUM = "CASE WHEN vendor_matched THEN 0.28 ELSE 0 END + CASE WHEN known AND by_product THEN 0.32 WHEN known THEN 0.22 ELSE 0 END + CASE WHEN known AND register IS NOT NULL THEN 0.18 ELSE 0 END + CASE WHEN trim(firmware) <> '' THEN 0.08 ELSE 0 END + CASE WHEN serial IS NOT NULL THEN 0.06 ELSE 0 END"
CODES = """concat_ws(',', CASE WHEN vendor_matched THEN 'vendor' END, CASE WHEN known AND by_product THEN 'product-code' WHEN known THEN 'fingerprint' END,
  CASE WHEN known AND register IS NOT NULL THEN 'metadata' END, CASE WHEN trim(firmware) <> '' THEN 'firmware' END, CASE WHEN serial IS NOT NULL THEN 'serial' END)"""
WIRE = "CASE transport WHEN 'tcp' THEN 'modbus_tcp' WHEN 'serial' THEN 'rtu' END"
WARNED = "concat_ws(',', CASE WHEN known AND metadata_error IS NOT NULL THEN 'metadata-unavailable' END, CASE WHEN beyond THEN 'newer-firmware' END)"


@query(f"""WITH {DEVICES}, s AS (SELECT *, least(1.0, CAST({SUM} AS DOUBLE)) AS c FROM n)
SELECT device_id, profile, round(c, 6) AS confidence, CASE WHEN NOT known THEN 'generic' WHEN beyond THEN 'newer-firmware-unverified' WHEN round(c, 9) >= 0.85 THEN 'verified'
  WHEN round(c, 9) >= 0.6 THEN 'probable' ELSE 'family-only' END AS status, array_to_string(list_sort(list_filter(['history', 'alarms', {WIRE},
  CASE register WHEN 'soc' THEN 'battery_soc' WHEN 'generator_state' THEN 'generator_control' END], lambda x: x IS NOT NULL)), ',') AS capabilities,
  {CODES} AS evidence, {WARNED} AS warnings FROM s""")
def device_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(evidence.resolved(devices(spark, sf_dir)))


@query(f"""WITH {DEVICES}, v AS (SELECT o_custkey AS device_id, o_orderkey % 4 AS k, o_totalprice / 400 AS value, CASE o_orderkey % 3 WHEN 0 THEN 'V' WHEN 1 THEN 'C' END AS unit FROM orders),
g AS (SELECT device_id, count(*) FILTER ((unit = 'V' AND NOT value BETWEEN -1 AND 1000) OR (unit = 'C' AND NOT value BETWEEN -80 AND 180)) AS wrong,
  bool_or(k = 0) AS load, bool_or(k = 1) AS rts FROM v WHERE k < 3 GROUP BY ALL),
j AS (SELECT n.*, g.device_id IS NOT NULL AS named, coalesce(wrong, 0) AS wrong, coalesce(load, false) AS load, coalesce(rts, false) AS rts FROM n LEFT JOIN g USING (device_id)),
s AS (SELECT *, greatest(0.0, least(1.0, CAST({SUM} + CASE WHEN named THEN 0.08 ELSE 0 END + CASE WHEN wrong > 0 THEN -0.3 WHEN named THEN 0.12 ELSE 0 END AS DOUBLE))) AS c FROM j)
SELECT device_id, profile, round(c, 6) AS confidence, CASE WHEN NOT known THEN 'generic' WHEN wrong > 0 THEN 'invalid' WHEN beyond THEN 'newer-firmware-unverified'
  WHEN round(c, 9) >= 0.85 THEN 'verified' WHEN round(c, 9) >= 0.6 THEN 'probable' ELSE 'family-only' END AS status, array_to_string(list_sort(list_filter(['history', 'alarms', {WIRE},
  CASE WHEN load THEN 'load_control' END, CASE WHEN rts THEN 'remote_temperature_sensor' END], lambda x: x IS NOT NULL)), ',') AS capabilities,
  concat_ws(',', nullif({CODES}, ''), CASE WHEN named THEN 'named-registers,telemetry-plausibility' END) AS evidence,
  CASE WHEN wrong > 0 THEN concat_ws(',', nullif({WARNED}, ''), 'implausible-value') ELSE {WARNED} END AS warnings FROM s""")
def refreshed_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices after two polls of the same values: what the first told is replaced, not repeated."""
    values = lens.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS device_id",
        "element_at(array('load_state', 'rts_temp', 'volts', 'holding_0x0001'), CAST(o_orderkey % 4 AS INT) + 1) AS register_name",
        "o_totalprice / 400 AS value",
        "CASE o_orderkey % 3 WHEN 0 THEN 'V' WHEN 1 THEN 'C' END AS unit",
    )
    once = evidence.refreshed(evidence.resolved(devices(spark, sf_dir)), values, ["device_id"])
    again = told(evidence.refreshed(once, values, ["device_id"]))
    return again.withColumn("warnings", F.array_join(F.array_distinct(F.split("warnings", ",")), ","))
