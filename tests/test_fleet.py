"""Small cases of identities, findings, archives, landing files and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlore.functions import frames, text
from gridlore.operators import findings, fleet, outlook
from gridlore.plans import fleet as plans
from gridlore.sources import archive, landing
from gridlore.streaming import live

TABLES = "/root/testdata/sf0.001"


def crc(data):
    value = 0xFFFF
    for b in data:
        value ^= b
        for _ in range(8):
            value = value >> 1 ^ (0xA001 if value & 1 else 0)
    return value


def test_checksums(spark):
    hexes = ["0103000000014480", "00", "ffff01020304", "zz", None, "123"]
    rows = spark.createDataFrame([(h,) for h in hexes], "h string").select("h", frames.crc16(frames.hex_bytes(F.col("h"))).alias("crc")).collect()
    for r in rows:
        whole = r.h and len(r.h) % 2 == 0 and r.h != "zz"
        assert r.crc == (crc(bytes.fromhex(r.h)) if whole else None)
    told = [(r.l_orderkey, r.l_linenumber, crc(r.w0.to_bytes(2, "big") + r.w1.to_bytes(2, "big"))) for r in plans.lens.words(spark, TABLES).collect()]
    assert sorted(map(tuple, plans.frame_checksums(spark, TABLES).collect())) == sorted(told)


def test_hour_meters_and_slugs(spark):
    rows = spark.createDataFrame([("99d 2h", 2378.0), ("5 h", 5.0), ("1,200.5", 1200.5), ("none", None), (None, None)], "v string, told double")
    assert all(r.told == r.got for r in rows.select("told", text.hour_meter(F.col("v")).alias("got")).collect())
    assert spark.createDataFrame([(" Sun & Wind (2) ",)], "v string").select(text.slug(F.col("v"))).first()[0] == "sun_wind_2"


def test_lifecycle(spark):
    outcomes = [(n, 1, dt.datetime(2024, 1, 1, 0, n), ok) for n, ok in enumerate([False, True, False, False, False, False, True])]
    rows = spark.createDataFrame(outcomes, "sample_id long, device_id long, observed_at timestamp_ntz, success boolean")
    got = fleet.lifecycle(rows, ["device_id"]).orderBy("sample_id").collect()
    assert [r.status for r in got] == ["connecting", "online", "degraded", "degraded", "offline", "offline", "online"]
    assert [r.wait_s for r in got] == [1, 1, 1, 2, 4, 8, 1]


def test_hosts_with_two_controllers_assign_none(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, host string")
    candidates = spark.createDataFrame([("a", 7), ("a", 7), ("b", 8), ("b", 9), (None, 3)], "host string, controller_id long")
    assert {r.id: r.controller_id for r in fleet.assigned_by_host(events, candidates).collect()} == {1: 7, 2: None, 3: None}


def test_graph_of_unknown_products(spark):
    members = spark.createDataFrame([(1, 2)], "system_id long, controller_id long")
    products = spark.createDataFrame([(2, 0, " AB "), (2, 1, None), (2, 2, "ab")], "controller_id long, slot long, serial string")
    nodes, edges = fleet.component_graph(members, products)
    assert sorted(r.kind for r in nodes.collect()) == ["bus", "controller", "product", "product", "system"]
    assert sorted(r.confidence for r in edges.where("relation = 'monitors'").collect()) == [0.5, 1.0]


def test_nothing_is_found_where_nothing_is_known(spark):
    names = "terminal_v sense_v input_w output_w polls success_rate miss_rate state_samples absorptions days coverage_percent solar_w solar_median solar_low"
    nulls = [F.lit(None).cast("double").alias(n) for n in names.split()]
    words = [F.lit(None).cast("string").alias(n) for n in ("status", "fault", "alarm")]
    figures = spark.range(1).select(F.col("id").alias("controller_id"), *words, *nulls)
    assert [(r.detector, r.severity) for r in findings.findings(figures).collect()] == [("controller_offline", "warning")]


def test_outlook_of_an_empty_day(spark):
    curve = spark.createDataFrame([(600, 10.0, 40.0, 80.0), (900, 20.0, 60.0, 100.0)], "slot long, p10 double, p50 double, p90 double")
    today = spark.createDataFrame([], "slot long, value double")
    r = outlook.solar_outlook(curve, today, [], 720).first()
    assert (r.observed, r.expected, r.end_p10, r.end_p90, r.coverage) == (0.0, 10.0, 5.0, 25.0, 0.0)


def samples(spark, days=3):
    rows = [(n, n % 4, dt.datetime(2024, 1, 1 + n % days, n % 24), float(n)) for n in range(60)]
    return spark.createDataFrame(rows, "sample_id long, device_id long, observed_at timestamp_ntz, numeric_value double")


def test_only_verified_days_are_pruned(spark, tmp_path):
    rows, path = samples(spark), str(tmp_path / "days")
    archive.write_days(rows, path, files_a_day=2)
    archive.write_days(rows.where("day(observed_at) = 2 and sample_id <> 1"), path)  # a day that lost a row
    kept = spark.read.parquet(path)
    days = archive.prunable(archive.manifest(rows), archive.manifest(kept), F.lit("2024-01-03").cast("date")).collect()
    assert [(str(r.day), r.n) for r in days] == [("2024-01-01", 20)]
    assert kept.count() == 59


def test_upserts(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, at long, v string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e"), (None, 1, "f")], "k long, at long, v string")
    assert {r.k: r.v for r in archive.latest_wins(old, new, ["k"], ["at"]).collect()} == {1: "c", 2: "b", 3: "e", None: "f"}
    twice = new.unionByName(new.withColumn("at", F.col("at") + 1))
    assert sorted((r.k or 0, r.at) for r in archive.append_new(old, twice, "k", ["at"]).collect()) == [(0, 1), (0, 2), (3, 1)]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2], None)], "id long, words array<int>, note string").coalesce(1)
    archive.export_csv(rows, str(tmp_path / "csv"), ["words", "id"])
    archive.export_json(rows, str(tmp_path / "json"))
    said = lambda kind: spark.read.text(str(tmp_path / kind)).collect()
    assert [r.value for r in said("csv")] == ["words,id", '"[1,2]",1'] and said("json")[0].value == '{"id":1,"words":[1,2],"note":null}'


def test_exchanges_have_the_words_of_their_replies(spark, tmp_path):
    lines = [
        '{"timestamp":"2026-08-14T00:00:01+00:00","unit_id":1,"function_code":3,"address":0,"count":2,"response_pdu_hex":"030400640050"}',
        '{"timestamp":"x","unit_id":1,"function_code":3,"address":9,"count":1,"response_pdu_hex":"8302","error":"illegal address"}',
        '{"unit_id":1,"function_code":3,"response_pdu_hex":"0300"}',
        "not json",
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = landing.exchanges(spark, str(tmp_path / "log.jsonl")).collect()
    assert [r.words for r in got] == [[100, 80], None, []] and got[0].recorded_at is not None and got[1].recorded_at is None


def test_labels_and_numbers(spark):
    rows = spark.createDataFrame([(" A:b\u2003C: ", "a b c"), ("Day:", "day"), (None, None)], "v string, told string")
    assert all(r.told == r.got for r in rows.select("told", text.label_key(F.col("v")).alias("got")).collect())
    rows = spark.createDataFrame([(".5 V", 0.5), ("-1,234.5", -1234.5), ("+3", 3.0), ("none", None)], "v string, told double")
    assert all(r.told == r.got for r in rows.select("told", text.first_number(F.col("v")).alias("got")).collect())
    rows = spark.createDataFrame([("12 days", 12.0), ("3 dogs", 3.0), ("2d 3h", 51.0), ("1.5 h", 1.5), ("", None)], "v string, told double")
    assert all(r.told == r.got for r in rows.select("told", text.hour_meter(F.col("v")).alias("got")).collect())


def test_replay(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"n":1,"function":"holding","address":5,"count":2,"words":[1,2]}\n\n{"n":2,"function":"holding","address":9,"count":1}\n')
    recorded = landing.transactions(spark, str(tmp_path / "log.jsonl"))
    assert recorded.count() == 2 and landing.replay_mismatches(recorded, recorded).count() == 0
    other = recorded.withColumn("address", F.when(F.col("n") == 2, 8).otherwise(F.col("address")).cast("long"))
    assert [r.n for r in landing.replay_mismatches(other.unionByName(other.withColumn("n", F.col("n") + 2)), recorded).orderBy("n").collect()] == [2, 3, 4]


def test_tables_with_days_as_columns(spark):
    html = """<table><tr><td>x</td></tr></table><table><tr><th>Day:</th><td>0</td><td>-1</td><td>-2</td><td>1</td></tr>
      <tr><td>Charge (Wh)</td><td>1,200.5</td><td>900</td><td></td><td>7</td></tr></table>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>open")], "page_id long, html string")
    on = pages.select("page_id", F.lit("2024-03-01").cast("date").alias("retrieved_on"))
    cells = landing.table_cells(pages)
    assert cells.where("page_id = 3").first().text == "open"
    got = landing.day_records(cells, on).orderBy(F.desc("controller_day")).collect()
    assert [(str(r.controller_day), r.label, r.number, r.is_complete) for r in got] == [
        ("2024-03-01", "charge wh", 1200.5, False), ("2024-02-29", "charge wh", 900.0, True), ("2024-02-28", "charge wh", None, True)
    ]


@pytest.fixture
def stream(spark, tmp_path):
    """The rows of a list of batches, in files that are read one at a time."""

    def make(batches):
        schema = "sample_id long, device_id long, observed_at timestamp_ntz, numeric_value double, state string"
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    return make


def minute(n, m, state="A", device=1):
    return (n, device, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), float(n), state)


def test_state_lasts_over_batches(spark, stream, tmp_path):
    rows = stream([[minute(1, 0, "A"), minute(2, 6, "A")], [minute(3, 11, "B"), minute(4, 12, None)], [minute(5, 21, "B"), minute(6, 30, "A")]])
    moved = live.drain(spark, live.changes(rows, ["device_id"]), str(tmp_path)).orderBy("sample_id").collect()
    assert [(r.sample_id, r.previous, r.state) for r in moved] == [(3, "A", "B"), (6, "B", "A")]
    kept = live.drain(spark, live.rate_limited(rows, ["device_id"], 600), str(tmp_path))
    assert sorted(r.sample_id for r in kept.collect()) == [1, 3, 5]


def test_stream_buckets_and_sightings(spark, stream, tmp_path):
    rows = stream([[minute(1, 0), minute(2, 6)], [minute(2, 6), minute(3, 14)], [minute(9, 600)], [minute(10, 1200)]])
    once = live.drain(spark, live.first_sightings(rows, ["sample_id"]), str(tmp_path))
    assert sorted(r.sample_id for r in once.collect()) == [1, 2, 3, 9, 10]
    closed = live.drain(spark, live.rollup(rows, ["device_id"], 900), str(tmp_path)).orderBy("bucket_start").collect()
    assert (closed[0].n, closed[0].low, closed[0].last_value) == (4, 1.0, 3.0)
