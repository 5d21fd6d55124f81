"""Sites: topology, metric history, points, charge cycles, recorded days, events; and texts of other zones and scripts."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlore.functions import decoders, text
from gridlore.operators import series, site, timeline
from gridlore.sources import landing

T = datetime(2024, 1, 2)


def at(minutes):
    return T + timedelta(minutes=minutes)


def test_topology_and_bridges(spark):
    members = spark.createDataFrame([(1, "A", "a"), (1, "B", "b"), (1, "C", "c"), (2, "D", "d")], "system_id long, controller_uid string, controller_id string")
    identities = spark.createDataFrame([("a", "p", "f", None)], "controller_id string, profile string, family string, model string")
    links = [("a", "tcp", "h", 502, 1, True, 1), ("b", "tcp", "h", 502, 2, True, 1), ("c", "tcp", "h", 503, 1, True, 1), ("a", "tcp", "g", None, 1, True, 1), ("b", "tcp", "g", None, 1, False, 1), ("d", "tcp", "h", 502, 1, True, 1), ("c", "serial", "/dev/x", 1, 1, True, 1)]
    connections = spark.createDataFrame(links, "controller_id string, transport string, target string, port int, unit_id int, active boolean, last_seen int")
    nodes, edges, bridges = timeline.topology(members, identities, connections)
    assert {(r.system_id, r.node_id, r.profile) for r in nodes.collect()} == {
        (1, "A", "p"), (1, "B", ""), (1, "C", ""), (2, "D", ""), (1, "tcp:h:502", ""), (1, "tcp:h:503", ""), (1, "tcp:g:0", ""), (2, "tcp:h:502", ""), (1, "serial:/dev/x", ""),
    }
    assert edges.count() == len(links)
    assert {(r.target, r.port, r.controller_uid, r.unit_id) for r in bridges.collect()} == {("h", 502, "A", 1), ("h", 502, "B", 2)}


def test_metric_history_takes_the_last_of_each_controller(spark):
    aliases = spark.createDataFrame([("m", "x", 1), ("m", "y", 2), ("t", "x", 1)], "metric string, register_name string, priority int")
    rows = [("s", 1, 1, at(1), "y", 9.0), ("s", 1, 2, at(1), "x", 5.0), ("s", 1, 3, at(2), "y", 7.0), ("s", 2, 4, at(1), "x", None), ("s", 2, 5, at(70), "x", 4.0), ("s", 3, 6, at(0), "x", 1.0)]
    told = spark.createDataFrame(rows, "site string, controller_id long, sample_id long, observed_at timestamp, register_name string, value double")
    expected = spark.createDataFrame([("s", 3)], "site string, expected long")
    chosen = timeline.one_alias(told, aliases, ["site"])
    got = {(r.metric, r.bucket_start % 86400 // 3600): (r.value, r.contributors, r.quality, r.oldest_age_ms) for r in timeline.metric_history(chosen, ["site"], 3600, {"m": "sum", "t": "latest"}, expected, ["site"], F.lit(at(60))).collect()}
    assert got == {("m", 0): (8.0, 3, "complete", 3_600_000.0), ("m", 1): (4.0, 1, "partial", 0.0), ("t", 0): (5.0, 3, "complete", 3_600_000.0), ("t", 1): (4.0, 1, "partial", 0.0)}


def test_points_names_and_first_uses(spark):
    rows = spark.createDataFrame([("k", n, f"v{n % 3}", n) for n in range(7)] + [("k", 7, None, 7)], "k string, n long, v string, address long")
    parts = {r.part: ([p.n for p in r.points], r.n) for r in timeline.points(rows, ["k"], ["n"], ["n"], 3).collect()}
    assert parts == {0: ([0, 1, 2], 3), 1: ([3, 4, 5], 3), 2: ([6, 7], 2)}
    turned = rows.withColumn("n", -F.col("n"))
    assert timeline.distinct_in_order(turned, ["k"], "v", ["n"]).first()["values"] == ["v0", "v2", "v1"]
    named = timeline.by_name(rows.select("k", F.col("v").alias("register_name"), F.col("n").alias("value"), "address").where("v is not null"), ["k"]).first()
    assert named["values"] == {"v0": 6, "v1": 4, "v2": 5}


def test_charge_cycle_of_a_day(spark):
    rows = [(1, at(0), 1, "float"), (1, at(10), 2, " FLOAT"), (1, at(20), 3, " "), (1, at(24), 4, None), (1, at(30), 5, "Absorption"), (1, at(31), 6, "float"), (1, at(-1441), 0, "bulk"), (1, at(60), 9, "bulk"), (2, at(1), 7, "")]
    samples = spark.createDataFrame(rows, "device_id long, observed_at timestamp, sample_id long, state string")
    got = {r.device_id: r for r in site.charge_cycle(samples, ["device_id"], F.lit(at(40))).collect()}
    one = got[1]
    assert (one.observed_samples, one.transition_count, one.absorption_entries, one.float_entries) == (6, 2, 1, 2)
    assert one.stage_sequence == ["FLOAT", "ABSORPTION", "FLOAT"] and one.seconds_by_state == {"ABSORPTION": 60.0, "FLOAT": 600.0}
    assert (got[2].observed_samples, got[2].transition_count, got[2].stage_sequence) == (1, 0, None)


VALUE = "controller_uid string, sample_id long, observed_at timestamp, register_name string, numeric_value double, text_value string"


def test_transitions_say_what_has_changed(spark):
    rows = [
        ("u", 1, at(1), "charge_state", None, "bulk"), ("u", 2, at(2), "charge_state", None, "bulk"), ("u", 3, at(3), "charge_state", None, "float"), ("u", 4, at(4), "charge_state", 5.0, "float"),
        ("u", 5, at(5), "faults", 0.0, None), ("u", 6, at(6), "faults", 3.0, None), ("u", 7, at(7), "faults", None, "None"), ("u", 8, at(1), "alarms", None, None), ("u", 9, at(2), "alarms", None, "hot"),
        ("u", 10, at(3), "alarms", None, "cold"), ("u", 11, at(4), "alarms", None, None), ("u", 12, at(9), "volts", 1.0, None), ("u", 13, at(10), "volts", 2.0, None),
    ]
    got = [(r.event_id.split(":")[2], r.event_type, r.severity, r.detail) for r in timeline.transitions(spark.createDataFrame(rows, VALUE)).collect()]
    assert sorted(got, key=lambda r: int(r[0])) == [
        ("3", "FLOAT_ENTERED", "info", "bulk > float"),
        ("4", "CHARGE_STATE_CHANGED", "info", "float > 5.0"),
        ("6", "FAULT_STARTED", "critical", "0.0 > 3.0"),
        ("7", "FAULT_CLEARED", "info", "3.0 > None"),
        ("10", "ALARM_STARTED", "warning", "hot > cold"),
        ("11", "ALARM_CLEARED", "info", "cold"),
    ]


def test_the_newest_events_of_a_site_in_order(spark):
    stored = spark.createDataFrame([(f"e{n}", u, at(t), "X", "info", "s", "", "") for n, (u, t) in enumerate([("a", 5), ("a", 5), (None, 9), ("b", 1), ("gone", 3)])], "event_id string, controller_uid string, observed_at timestamp, event_type string, severity string, source string, message string, detail string")
    errors = timeline.poll_errors(spark.createDataFrame([(1, "a", 7, at(6), "x")], "error_id long, controller_uid string, device_id long, observed_at timestamp, error string"))
    members = spark.createDataFrame([(1, "a"), (2, "b")], "system_id long, controller_uid string")
    got = lambda **k: sorted((r.system_id, r.place, r.event_id) for r in timeline.timeline([stored, errors], members, **k).collect())
    assert got(most=2) == [(1, 1, "poll-error:1"), (1, 2, "e1"), (2, 1, "e3")]
    assert got(default_system=2) == [(1, 1, "poll-error:1"), (1, 2, "e1"), (1, 3, "e0"), (2, 1, "e2"), (2, 2, "e3")]


def test_recorded_days_have_fields_and_local_bounds(spark):
    html = (
        "<table><tr><td>Day:</td><td>0</td><td>-1</td></tr><tr><td>Hourmeter</td><td>99d\xa02h</td><td>2.5 d</td></tr><tr><td>Max Battery Voltage</td><td>1,028.5 V</td><td></td></tr>"
        "<tr><td>Event</td><td>3.9</td><td>4</td></tr><tr><td>Events</td><td></td><td>5</td></tr><tr><td>Faults</td><td> a  b </td></tr><tr><td>Extra</td><td>z</td></tr></table>"
    )
    pages = spark.createDataFrame([(1, html, date(2024, 3, 11))], "page_id long, html string, retrieved_on date")
    days = landing.day_fields(landing.day_records(landing.table_cells(pages), pages.select("page_id", "retrieved_on")), "America/Denver")
    new, old = days.orderBy(F.desc("controller_day")).collect()
    assert (new.hourmeter_hours, new.battery_voltage_max, new.event_count, new.faults, new.other, new.is_complete, new.offset) == (2378.0, 1028.5, 3, "a b", {"extra": "z"}, False, 0)
    assert (old.hourmeter_hours, old.battery_voltage_max, old.event_count, old.faults, old.other, old.is_complete, old.offset) == (2.5, None, 5, None, {}, True, -1)
    assert (old.day_start_utc, old.day_end_utc) == (datetime(2024, 3, 10, 7), datetime(2024, 3, 11, 6))  # the clocks change on that day


def test_cells_of_recorded_days_are_parsed_once_and_not_broadcast(spark, capsys):
    day = "<table><tr><td>Day</td><td>0</td><td>1</td><td>-300</td><td>x</td></tr><tr><td>A</td><td>{}</td><td>2</td><td>3</td><td>4</td><td>5</td></tr></table>"
    html = [day.format(7) + day.format(8), "<table><tr><td>A</td><td>1</td></tr></table>" + day.format(9), "<table><tr><td>no day</td></tr></table>", None]
    pages = spark.createDataFrame([(n, h, date(2024, 3, 11)) for n, h in enumerate(html)], "page_id long, html string, retrieved_on date")
    records = landing.day_records(landing.table_cells(pages), pages.select("page_id", "retrieved_on"))
    assert sorted((r.page_id, r.controller_day, r.label, r.value) for r in records.collect()) == [(0, date(2024, 3, 11), "a", "7"), (1, date(2024, 3, 11), "a", "9")]
    capsys.readouterr()
    landing.day_fields(records, "UTC").explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and plan.count("MapInPandas") == 1 and plan.count("Exchange") == 2


@pytest.mark.parametrize("zone", ["UTC", "America/Denver", "Asia/Kolkata"])
def test_times_without_a_zone_are_utc_in_every_session(spark, zone):
    told = ["2024-01-05", "2024-01-05T10", "2024-01-05T10:30", "2024-01-05 10:30:05", "2024-01-05T10:30:00-07:00", "2024-01-05T10:30:00Z", "2024-01-05T10:30:00+0200", "2024-13-05", "noon"]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r[0] for r in spark.createDataFrame([(t,) for t in told], "t string").select(F.unix_seconds(text.lenient_time(F.col("t")))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    day = 1704412800
    assert got == [day, day + 36000, day + 37800, day + 37805, day + 63000, day + 37800, day + 30600, None, None]


def test_names_are_folded(spark):
    rows = spark.createDataFrame([(" STRASSE\x00", "straße "), ("ΣΑΣ", "σας"), ("µF", "μf"), ("ﬁle", "FILE")], "a string, b string")
    assert all(r[0] for r in rows.select(text.plain_name(F.col("a")) == text.plain_name(F.col("b"))).collect())


@pytest.mark.parametrize("decoder", ["f32", "s32", "s32_factor:2", "u32", "u32_factor:2"])
def test_pairs_need_two_words(spark, decoder):
    rows = spark.createDataFrame([([16256, 0],), ([1, 2, 3],), ([1],), ([],)], "w array<int>")
    made = rows.select(decoders.decode(F.lit(decoder), F.col("w"), F.create_map().cast("map<int,int>"))["number"]).collect()
    assert made[0][0] is not None and [r[0] for r in made[1:]] == [None, None, None]


def test_addresses_and_wire_times(spark):
    row = spark.range(1).select(decoders.bus_address(F.lit(0x0215)).alias("a"), decoders.wire_seconds(F.lit(8), F.lit(165), F.lit(9600), F.lit(11)).alias("s"), decoders.wire_seconds(F.lit(8), F.lit(165), F.lit(0), F.lit(11)).alias("n")).first()
    assert (row.a.bus, row.a.address) == (2, 0x15) and abs(row.s - 173 * 11 / 9600) < 1e-12 and row.n is None


def test_aliases_as_one_expression(spark):
    aliases = [("sun", "a", 2), ("sunny", "b", 2), ("day", "c", 1), ("dax", "d", 1)]
    texts = spark.createDataFrame([(1, "sunny"), (2, "sunday"), (3, "sun"), (4, "x"), (5, None)], "id long, text string")
    one = {r.id: r.p for r in texts.select("id", series.by_alias(F.col("text"), aliases).alias("p")).collect()}
    assert one == {1: "b", 2: "c", 3: "a", 4: None, 5: None}
    assert one == {r.id: r.profile for r in series.longest_alias(texts, spark.createDataFrame(aliases, "alias string, profile string, priority int"), ["id"]).collect()}
