"""Chart and report reads: the cases that tables of the driver do not have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlore.functions import text
from gridlore.operators import series

POINTS = "sample_id long, device_id long, observed_at timestamp_ntz, register_name string, kind string, unit string"
T = dt.datetime(2024, 1, 1)


def test_headers_of_mixed_kinds_late_units_and_nothing(spark):
    rows = [(1, 1, T, "a", "numeric", None), (2, 1, T, "a", None, "V"), (3, 1, T, "a", "numeric", "A"), (4, 1, T, "b", None, None)]
    got = {r.register_name: r for r in series.headers(spark.createDataFrame(rows, POINTS), ["device_id", "register_name"]).collect()}
    assert (got["a"].kind, got["a"].unit, got["a"].n) == ("mixed", "V", 3)
    assert (got["b"].kind, got["b"].unit) == ("unknown", None)
    assert series.headers(spark.createDataFrame([], POINTS), ["device_id"]).count() == 0


def test_names_and_values_that_ask_for_nothing(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "register_name string, n int")
    assert series.clean_names([" b", "a", "", "b "]) == ["b", "a"]
    assert series.named(rows, ["  "]).count() == 3 and series.named(rows, [" a "]).count() == 1
    assert series.matching(rows, n=None).count() == 3 and series.matching(rows, n=2, register_name=None).count() == 1
    assert rows.where(series.in_or_unset(F.col("register_name"), ["a"])).count() == 2


def test_guard_lets_exactly_the_limit_pass(spark):
    assert series.guarded(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        series.guarded(spark.range(6), 5)


def test_local_days_follow_the_clock(spark):
    days = spark.createDataFrame([(dt.date(2024, 3, 10),), (dt.date(2024, 11, 3),), (dt.date(2024, 6, 1),)], "day date")
    start, end = series.day_bounds(F.col("day"), "America/Denver")
    got = [tuple(r) for r in days.select(start, end).collect()]
    assert got[0][0] == dt.datetime(2024, 3, 10, 7)
    assert [(b - a).total_seconds() / 3600 for a, b in got] == [23, 25, 24]


def test_age_and_freshness(spark):
    now = F.lit(dt.datetime(2024, 1, 1, 0, 2)).cast("timestamp_ntz")
    rows = spark.createDataFrame([(T,), (T + dt.timedelta(hours=1),), (T - dt.timedelta(seconds=1),), (None,)], "at timestamp_ntz")
    got = [tuple(r) for r in rows.select(series.age_ms(now, F.col("at")), series.fresh(now, F.col("at"))).collect()]
    assert got[:3] == [(120000.0, True), (0.0, True), (121000.0, False)] and got[3][1] is False


def test_health_of_a_site(spark):
    rows = [(1, "online", True, True), (2, "online", True, False), (3, None, True, True), (4, "offline", False, True)]
    sites = spark.createDataFrame(rows, "site_id int, status string, fault_clear boolean, alarm_clear boolean")
    got = {r.site_id: r.health for r in series.system_health(sites, ["site_id"]).collect()}
    assert got == {1: "ok", 2: "warning", 3: "warning", 4: "critical"}


def test_units_that_are_not_set_match(spark):
    values = spark.createDataFrame([("a", None), ("a", "V")], "register_name string, unit string")
    entries = spark.createDataFrame([("a", "", 1), ("a", "V", 2)], "register_name string, unit string, entry int")
    assert sorted(r.entry for r in series.described(values, entries, ["register_name"]).collect()) == [1, 2]


def test_longest_alias_within_a_priority(spark):
    aliases = spark.createDataFrame([("tri", "x", 1), ("tristar", "y", 1), ("s", "z", 0)], "alias string, profile string, priority int")
    texts = spark.createDataFrame([(1, "a tristar"), (2, "tri"), (3, "none"), (4, None)], "id int, text string")
    got = {r.id: r.profile for r in series.longest_alias(texts, aliases, ["id"]).collect()}
    assert got == {1: "z", 2: "x", 3: None, 4: None}


@pytest.mark.parametrize(
    "said, at",
    [
        ("2024-01-01T02:00:00", "2024-01-01 02:00"),
        ("2024-01-01T02:00:00Z", "2024-01-01 02:00"),
        ("2024-01-01T02:00:00+02:00", "2024-01-01 00:00"),
        ("2024-01-01", "2024-01-01 00:00"),
        ("later", None),
        ("", None),
        (None, None),
    ],
)
def test_lenient_times(spark, said, at):
    row = spark.createDataFrame([(said,)], "t string").select(F.date_format(text.lenient_time(F.col("t")), "yyyy-MM-dd HH:mm")).first()
    assert row[0] == at


def test_plain_names_fields_and_register_names(spark):
    row = spark.range(1).select(
        text.plain_name(F.lit("\x00 TriStar\x00")).alias("a"),
        text.field_of(F.lit("Max. Battery  Voltage:")).alias("b"),
        text.field_of(F.lit("other")).alias("c"),
        text.register_name(F.lit("holding"), F.lit(26)).alias("d"),
    ).first()
    assert tuple(row) == ("tristar", "battery_voltage_max", None, "holding_0x001A")
