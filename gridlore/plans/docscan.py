"""Queries on documents, over the text of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.operators import catalog, docscan
from gridlore.plans.telemetry import query
from gridlore.sources import lens

#: The text between tags, as lines of a register table: a line's digest gives its address, and makes some lines headings, others prose.
KIND = "substr(md5(line), 5, 2)"
AS_ROW = f"""CASE {KIND} WHEN '00' THEN 'RAM Registers:' WHEN '11' THEN 'EEPROM settings' WHEN '22' THEN ' Logged  Data' WHEN '33' THEN 'Coils -' WHEN '44' THEN 'Examples'
  WHEN '55' THEN 'Discrete Inputs' WHEN '66' THEN line WHEN '77' THEN concat('see 0x0010 ', line) WHEN '88' THEN concat('0x0', substr(md5(line), 1, 3), ' - Reserved')
  WHEN '99' THEN concat('0x00', substr(md5(line), 1, 2), ' 12 LOAD_', substr(md5(line), 9, 1), '_0 float32') WHEN 'aa' THEN concat('0x00', substr(md5(line), 1, 2), ' CLEAR_', line)
  WHEN 'bb' THEN concat('0x0', substr(md5(line), 1, 3), ' ', line, ' write only') ELSE concat('0x', substr(md5(line), 1, 4), ' ', line) END"""
TEXTS = f"""SELECT page_id // 4 AS source_id, page_id % 4 + 1 AS page, list_transform(list_filter(list_transform(string_split_regex(html, '<[^>]*>|\\n'),
  lambda x: trim(regexp_replace(x, '[^ -~]', '', 'g'))), lambda x: length(x) > 1), lambda line: {AS_ROW}) AS lines FROM pages"""
ROW = r"^\s*0[xX]([0-9A-Fa-f]{4})(?:\s+(?:\d{1,5}|-))?\s+([A-Za-z][A-Za-z0-9_\[\]./-]{1,})\b"
OBSERVED = rf"""t AS ({TEXTS}), l AS (SELECT source_id, page, n, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line
  FROM (SELECT source_id, page, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS n FROM t)),
h AS (SELECT *, regexp_extract(line, '{ROW}', 1) AS hex, regexp_extract(line, '{ROW}', 2) AS label, trim(lower(line), ' :-') AS p FROM l),
s AS (SELECT *, CASE WHEN hex <> '' OR length(p) > 96 THEN NULL WHEN p = 'ram' OR p LIKE 'ram registers%' THEN 'runtime' WHEN p = 'eeprom' OR p LIKE 'eeprom %' THEN 'configuration'
  WHEN p IN ('logged data', 'logger') OR p LIKE 'logged data %' THEN 'log' WHEN p IN ('coil', 'coils') OR p LIKE 'coil address%' OR p LIKE 'discrete input%' THEN 'control'
  WHEN p IN ('example', 'examples') OR p LIKE 'examples %' THEN 'example' END AS opens FROM h),
f AS (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY page, n), 'runtime') AS section, CAST(('0x' || hex) AS BIGINT) AS address
  FROM (SELECT * REPLACE (CASE WHEN hex = '' THEN '0' ELSE hex END AS hex), hex <> '' AS is_row FROM s)),
r AS (SELECT *, CASE WHEN lower(label) = 'reserved' THEN 'reserved' WHEN address BETWEEN 32768 AND 36863 THEN 'log' WHEN address >= 57344 THEN 'configuration'
  WHEN contains(lower(line), 'float32') AND regexp_matches(label, '(?i)(_[01]|_HI|_LO)$') THEN 'alternate_encoding'
  WHEN section = 'control' OR contains(lower(line), 'set only') OR contains(lower(line), 'write only') OR contains(lower(line), 'write-only')
    OR regexp_matches(label, '(?i)^EQTRIG$|^CLEAR_|^RESET$|DISCONNECT$|RECONNECT$|OVERRIDE$|TRIGGER$') THEN 'control' ELSE section END AS scope,
  CASE WHEN regexp_matches(label, '[_\[0-9]') THEN CAST(0.95 AS DOUBLE) ELSE 0.85 END AS confidence FROM f WHERE is_row AND lower(label) NOT IN
  ('address', 'and', 'bit', 'description', 'instead', 'non', 'output', 'register', 'registers', 'unit', 'units', 'value', 'values', 'which')),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source_id, scope, address, lower(label) ORDER BY confidence DESC, page, n) = 1)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.filter(F.transform(F.split("html", "<[^>]*>|\n"), lambda x: F.trim(F.regexp_replace(x, "[^ -~]", ""))), lambda x: F.length(x) > 1)
    rows = lens.table(spark, sf_dir, "pages").withColumn("lines", line)
    made = F.expr(f"array_join(transform(lines, line -> {AS_ROW}), '\n')")
    return rows.select(F.expr("page_id div 4").alias("source_id"), (F.col("page_id") % 4 + 1).alias("page"), made.alias("text"))


@query(f"""WITH {OBSERVED} SELECT source_id, scope, address, label, page, CAST(n AS BIGINT) AS line_no, confidence, substr(line, 1, 300) AS source_text FROM b""")
def register_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docscan.register_observations(texts(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


#: A catalog of five profiles and, for each, registers of two words and blocks of four, a row of nation each.
PLACES = {"registers": "n_nationkey * 3 AS address, CAST(2 AS BIGINT) AS words", "blocks": "n_nationkey * 5 AS address, CAST(4 AS BIGINT) AS count"}


@query(f"""WITH {OBSERVED}, m AS (SELECT b.*, r_regionkey AS profile, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND address - n_nationkey * 3 BETWEEN 0 AND 1) AS named,
  EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND address - n_nationkey * 5 BETWEEN 0 AND 3) AS inside FROM b LEFT JOIN region ON r_regionkey = source_id % 7),
x AS (SELECT *, CASE WHEN profile IS NULL THEN 'unmapped_source' WHEN scope = 'reserved' AND named THEN 'declared_register_overlaps_reserved_vendor_row'
  WHEN scope <> 'runtime' THEN scope WHEN named THEN 'covered_named_register' WHEN inside THEN 'unnamed_field_in_read_block' ELSE 'runtime_address_outside_read_blocks' END AS outcome FROM m)
SELECT outcome, count(*) AS n FROM x GROUP BY ALL""")
def observation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the observations of all pages when a catalog is compared with them."""
    nation, region = (lens.table(spark, sf_dir, n) for n in ("nation", "region"))
    registers, blocks = (nation.selectExpr("n_regionkey AS profile", "n_name AS name", *p.split(", ")) for p in PLACES.values())
    observed = docscan.register_observations(texts(spark, sf_dir)).withColumn("source_id", F.col("source_id") % 7)
    found = catalog.compared(observed, region.selectExpr("r_regionkey AS profile", "r_regionkey AS source_id"), registers, blocks)
    return found.groupBy(F.coalesce("change_type", "ignored").alias("outcome")).agg(F.count("*").alias("n"))
