"""Every query with SQL against DuckDB, and the cases that tables of the driver do not have."""

import datetime as dt
import glob
import os
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from gridlore.functions import decoders, text, words
from gridlore.operators import daily, history, site
from gridlore.plans import catalog as telemetry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_scopes_of_all_sites(spark):
    rows = telemetry.QUERIES["scope_union_history_by_system"](spark, TABLES).collect()
    one = telemetry.QUERIES["scope_union_history"](spark, TABLES).collect()
    assert {r.system_id for r in rows} == set(range(5))
    assert sorted(tuple(r)[1:] for r in rows if r.system_id == 2) == sorted(map(tuple, one))


@pytest.mark.parametrize("name", sorted(telemetry.SQL))
def test_same_rows_as_sql(spark, duck, name):
    made = telemetry.QUERIES[name](spark, TABLES)
    told = duck.sql(telemetry.SQL[name])
    assert sorted(made.columns) == sorted(told.columns)
    rows = lambda found, names: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found), key=repr)
    assert rows(made.collect(), made.columns) == rows(told.fetchall(), told.columns)


def samples(spark, rows):
    schema = "sample_id long, device_id long, observed_at timestamp_ntz, register_name string, numeric_value double, state string"
    return spark.createDataFrame(rows, schema)


def at(minute, day=1):
    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minute)


def test_buckets_of_nulls_and_nothing(spark):
    empty = samples(spark, [])
    assert history.numeric_buckets(empty, ["device_id"], 60).count() == 0
    nulls = samples(spark, [(1, 1, at(0), "v", None, None)])
    assert history.numeric_buckets(nulls, ["device_id"], 60).count() == 0
    assert history.state_runs(nulls, ["device_id"]).count() == 0


def test_first_and_last_break_ties_by_sample(spark):
    rows = samples(spark, [(2, 1, at(0), "v", 5.0, "B"), (1, 1, at(0), "v", 4.0, "A"), (3, 1, at(1), "v", 4.5, "B")])
    r = history.numeric_buckets(rows, ["device_id"], 3600).first()
    assert (r.first_value, r.last_value, r.low, r.high, r.n) == (4.0, 4.5, 4.0, 5.0, 3)
    assert history.state_buckets(rows, ["device_id"], 3600).first().transitions == 1


def test_runs_merge_only_neighbours(spark):
    rows = samples(spark, [(n, 1, at(n), "s", None, s) for n, s in enumerate("AABBBA")])
    runs = history.state_runs(rows, ["device_id"]).orderBy("started_at").collect()
    assert [(r.state, r.n) for r in runs] == [("A", 2), ("B", 3), ("A", 1)]


def test_energy_skips_wide_gaps(spark):
    rows = samples(spark, [(1, 1, at(0), "p", 600.0, ""), (2, 1, at(5), "p", 600.0, ""), (3, 1, at(500), "p", 600.0, "")])
    r = daily.energy(rows, ["device_id"], 3600).first()
    assert (r.wh, r.integrated_s, r.skipped_s) == (50.0, 300.0, 29700.0)
    assert daily.energy(rows.limit(1), ["device_id"], 3600).first().wh is None


def test_rate_limit_depends_on_what_was_kept(spark):
    rows = samples(spark, [(n, d, at(m), "v", 1.0, "") for d in (1, 2) for n, m in enumerate((0, 6, 11, 16, 21, 40))])
    kept = history.rate_limited(rows, ["device_id"], 600).where("device_id = 2").orderBy("sample_id").collect()
    assert [r.sample_id for r in kept] == [0, 2, 4, 5]


def test_half_precision_of_every_word(spark):
    rows = spark.range(65536).select("id", words.binary16(F.col("id")).alias("v")).collect()
    for r in rows:
        (told,) = struct.unpack("<e", struct.pack("<H", r.id))
        assert (r.v is None) if told != told else (r.v == told)


def test_versions(spark):
    rows = spark.createDataFrame(
        [("29", True), ("29.0", True), ("18.9", False), ("v30.1", True), ("none", False), (None, False)], "v string, ok boolean"
    )
    found = rows.select("ok", text.firmware_allows(F.col("v"), F.lit("29.0"), F.lit(None).cast("string")).alias("got"))
    assert all(r.ok == r.got for r in found.collect())


def test_reconcile_keeps_what_was_not_evaluated(spark):
    schema = "fingerprint string, evaluation_key string, severity string"
    active = spark.createDataFrame([("a", "k1", "warning"), ("b", "k2", "warning"), ("c", "k3", "warning"), ("d", "k4", "warning")], schema)
    found = spark.createDataFrame([("a", "k1", "critical"), ("d", "k4", "warning"), ("e", "k5", "info")], schema)
    seen = spark.createDataFrame([("k1",), ("k2",), ("k4",), ("k5",)], "evaluation_key string")
    got = {r.fingerprint: r.action for r in site.reconcile(active, found, seen).collect()}
    assert got == {"a": "updated", "b": "resolved", "c": "kept", "d": "unchanged", "e": "opened"}


def test_versions_of_any_length(spark):
    rows = spark.createDataFrame([("1.2.3.4.5", "1.2.3.4.6", False), ("1.2.3.4.6", "1.2.3.4.5", True), ("2", "1.9.9.9.9", True), ("1.2", "1.2.0.0.0", True)], "v string, since string, told boolean")
    none = F.lit(None).cast("string")
    assert all(r.told == r.got for r in rows.select("told", text.firmware_allows(F.col("v"), F.col("since"), none).alias("got")).collect())


def test_reconcile_counts_and_sees_every_text(spark):
    schema = "fingerprint string, evaluation_key string, severity string, confidence string, title string, occurrence_count long"
    active = spark.createDataFrame([("a", "k1", "info", "low", None, 4), ("b", "k2", "info", "low", "t", 1)], schema)
    found = spark.createDataFrame([("a", "k1", "info", "low", "", 0), ("b", "k2", "info", "high", "t", 0), ("c", "k3", "info", "low", "t", 0)], schema)
    seen = spark.createDataFrame([("k1",), ("k2",)], "evaluation_key string")
    got = {r.fingerprint: (r.action, r.occurrences) for r in site.reconcile(active, found, seen).collect()}
    assert got == {"a": ("unchanged", 5), "b": ("updated", 2), "c": ("opened", 1)}


def test_health_of_all_subjects(spark):
    rows = [(1, "battery", "critical"), (1, "battery", "critical"), (1, "charging", "warning"), (2, "other", "critical"), (2, None, None)]
    found = spark.createDataFrame(rows, "device_id long, category string, severity string")
    every = spark.createDataFrame([(1,), (2,), (3,)], "device_id long")
    got = {r.device_id: (r.score, r.status, r.active_incidents) for r in site.health_score(found, ["device_id"], every).collect()}
    assert got == {1: (72, "warning", 3), 2: (98, "good", 2), 3: (100, "good", 0)}


def test_derived_power_needs_a_report(spark):
    rows = [(2210.45, 464.5, None, None), (500.0, 465.0, None, None), (None, 465.0, 1.0, 1.0), (2210.0, None, 13.25, 35.06), (900.0, None, None, None)]
    values = spark.createDataFrame(rows, "input_power double, output_power double, volts double, amps double")
    got = [(r.quality, r.power and round(r.power, 3)) for r in site.derived_power(values).collect()]
    assert got == [
        ("estimated_from_output", 464.5), ("reported_unverified", 500.0), (None, None), ("estimated_from_output", 464.545), ("reported_unverified", 900.0)
    ]


def test_decoders(spark):
    context = {0: 100, 1: 0, 2: 80, 3: 0, 4: 0x0018, 13: 230}
    cases = [
        ("tristar_voltage", [0x4000], 50.0, None), ("tristar_current", [0xC000], -40.0, None), ("tristar_power", [0x2000], 500.0, None),
        ("tristar_rts_temp", [0x80], None, "DISCONNECTED"), ("tristar_rts_temp", [0xFFFF], -1.0, None), ("ts600_voltage", [0x4000], 50.0, None),
        ("ts600_other", [7], 7.0, None), ("suresine_classic_current", [0x4000], 3.2, None), ("f16", [0x3C00], 1.0, None), ("f16_percent", [0x3800], 50.0, None),
        ("f32", [0x3F80, 0], 1.0, None), ("bitfield_words", [1, 2], 131073.0, None), ("u32", [1], None, None), ("u32_factor:0.1", [0, 10], 1.0, None),
        ("ascii_lo_hi", [0x4241, 0x0043], None, "ABC"), ("ascii_hi_lo", [0x4142, 0xFFFF], None, "AB"), ("ascii_hi_lo", [0x41C8, 0x2020], None, "A\ufffd"),
        ("percent:200", [50], 25.0, None), ("divide:10", [0xFFF6], -1.0, None), ("none", [1], None, None), ("raw", [], None, None),
    ]
    rows = spark.createDataFrame([(n, d, w, v, t, context) for n, (d, w, v, t) in enumerate(cases)], "n int, d string, w array<int>, v double, t string, c map<int,int>")
    for r in rows.select("*", decoders.decode(F.col("d"), F.col("w"), F.col("c")).alias("got")).collect():
        assert (r.got.number is None) == (r.v is None) and (r.v is None or abs(r.got.number - r.v) < 1e-9), r
        assert r.got.text == r.t, r
