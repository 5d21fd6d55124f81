"""Identity of controllers: components, redirects, registration, uids and scopes."""

import random

import pytest
from pyspark.sql import functions as F

from gridlore.operators import identity
from gridlore.sources import shared


def grouped(edges):
    """Brute force: the smallest node that each node reaches."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[n] = min(seen)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, seed):
    random.seed(seed)
    edges = [(f"n{random.randrange(90):02d}", f"n{random.randrange(90):02d}") for _ in range(60)]
    edges += [(f"chain{k:03d}", f"chain{k + 1:03d}") for k in range(70)] + [("hub", f"spoke{k}") for k in range(30)] + [("self", "self"), edges[0]]
    got = identity.components(spark.createDataFrame([*edges, ("x", None), (None, None)], "a string, b string"))
    assert {r.node: r.component for r in got.collect()} == grouped(edges)
    assert identity.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_redirects_settle_at_the_end_of_any_chain(spark):
    chain = [(k, k + 1) for k in range(33)] + [(100 + k, 5) for k in range(10)] + [(200, 200)]
    got = {r.old: r.new for r in identity.settled(spark.createDataFrame(chain, "old long, new long")).collect()}
    assert got == {k: 33 for k in [*range(33), *range(100, 110)]}
    for ring in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (9, 1)]):
        with pytest.raises(ValueError, match="ring"):
            identity.settled(spark.createDataFrame(ring, "old long, new long"))
    assert identity.settled(spark.createDataFrame([], "old long, new long")).count() == 0


def test_promotion_keeps_all_rows_and_merges_counters(spark):
    rows = spark.createDataFrame([("a", 1, 5, 2, 0.1), ("b", 3, 4, 1, 0.9), ("z", 1, 1, 1, 0.5), (None, 7, 7, 1, 0.2)], "controller_id string, first_seen long, last_seen long, observations long, confidence double")
    moves = identity.settled(spark.createDataFrame([("a", "b"), ("b", "c")], "old string, new string"))
    got = {tuple(r) for r in identity.merged_counters(identity.rekeyed(rows, moves), ["controller_id"]).collect()}
    assert got == {("c", 1, 5, 3, 0.9), ("z", 1, 1, 1, 0.5), (None, 7, 7, 1, 0.2)}


SEEN = "sample_id long, observed_at long, profile string, serial string, usb_serial string, unit long, endpoint string, device_id string"


def registered(spark, rows):
    """Rows of (serial, usb_serial, endpoint) in order; they are given in another one."""
    told = [(n, n // 2, " P ", s, u, 1, e, "old" if e == "E0" else None) for n, (s, u, e) in enumerate(rows)]
    random.seed(3)
    random.shuffle(told)
    got = identity.registrations(spark.createDataFrame(told, SEEN)).orderBy("sample_id").collect()
    return [(r.controller_id, r.canonical_device_id, r.match_strategy, r.match_confidence) for r in got]


def test_registration_walks_through_all_matches(spark):
    conflict = identity.conflict_device_id("P", "S2", "E1")
    assert registered(
        spark,
        [
            ("", None, "E1"),
            (" ", "", "E1"),
            ("S1", None, "E1"),
            (None, "U", "E1"),
            ("S1", None, "E2"),
            ("S2", None, "E1"),
            (None, None, "E1"),
            ("s1", None, "E1"),
            ("", "V", "E0"),
            ("", "V", "E9"),
            ("S3", "V", "E9"),
            (None, "V", "E0"),
            (None, None, None),
        ],
    ) == [
        ("endpoint:E1", "E1", "new_controller", 0.4),
        ("endpoint:E1", "E1", "endpoint", 0.8),
        ("serial:p:s1", "E1", "controller_serial_promotion", 1.0),
        ("serial:p:s1", "E1", "known_endpoint_owner", 0.95),
        ("serial:p:s1", "E1", "controller_serial", 1.0),
        ("serial:p:s2", conflict, "controller_serial_conflict", 0.95),
        ("serial:p:s2", conflict, "known_endpoint_owner", 0.95),
        ("serial:p:s1", "E1", "controller_serial", 1.0),
        ("usb:v:unit:1", "old", "new_controller", 0.4),
        ("usb:v:unit:1", "old", "usb_serial", 0.8),
        ("serial:p:s3", "old", "controller_serial_promotion", 1.0),  # takes both endpoints of the adapter over
        ("serial:p:s3", "old", "known_endpoint_owner", 0.95),
    ]


def test_registration_of_nothing(spark):
    assert identity.registrations(spark.createDataFrame([], SEEN)).count() == 0


def test_uids_stay_while_rows_are_added(spark):
    kind = "controller_id string, canonical_device_id string, first_seen long, last_seen long"
    rows = [("endpoint:1", "d5", 1, 2), ("serial:a", "d5", 3, 4), ("serial:a", "d1", 5, 6), ("serial:b", "d2", 1, 9), (None, "d2", 0, 0)]
    now = {}
    for upto in (2, 5):
        controllers, aliases = identity.physical(spark.createDataFrame(rows[:upto], kind))
        now[upto] = {r.controller_uid: r for r in controllers.collect()}
        active = [r.controller_id for r in aliases.where("active").collect()]
        assert sorted(active) == sorted(r.current_controller_id for r in now[upto].values())
    (uid,) = now[2]
    assert uid in now[5] and len(now[5]) == 2
    assert (now[5][uid].canonical_device_id, now[5][uid].current_controller_id, now[5][uid].first_seen, now[5][uid].last_seen) == ("d1", "serial:a", 1, 6)
    members = spark.createDataFrame([("serial:a", "d9", 2), ("serial:a", "d5", 1), ("serial:a", "d9", 1), ("endpoint:1", "dx", 0)], "controller_id string, device_id string, last_seen long")
    asked = spark.createDataFrame([("endpoint:1",), (uid,), ("serial:b",), ("nobody",), (uid,)], "identifier string")
    got = {r.identifier: (r.controller_uid, r.controller_id, r.history_device_ids) for r in identity.scopes(asked, controllers, aliases, members).collect()}
    assert got["endpoint:1"] == got[uid] == (uid, "serial:a", ["d5", "d9", "d1"])
    assert got["serial:b"][1:] == ("serial:b", ["d2"]) and "nobody" not in got


def test_only_the_newest_fresh_row_of_a_group_is_active(spark):
    kind = "device_id string, profile string, serial string, usb_serial string, unit int, endpoint string, status string, first_seen timestamp, last_seen timestamp"
    t = lambda s: f"2024-01-01 00:0{s}:00"
    rows = [("a", "P", "S", None, 1, "e1", "online", t(1), t(3)), ("b", "P", "s ", "u", 2, "e2", "ERROR", None, t(3)), ("c", "P", "", " U", None, "e3", "offline", t(2), t(4)), ("d", "P", None, None, 1, "e4", "online", None, None)]
    devices = spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows) + " AS t(device_id, profile, serial, usb_serial, unit, endpoint, status, first_seen, last_seen)")
    devices = devices.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in kind.split(", ")])
    got = {r.device_id: r for r in identity.bootstrap(devices, F.lit(t(4)).cast("timestamp")).collect()}
    assert {d: (r.controller_id, r.canonical_device_id, r.active) for d, r in got.items()} == {
        "a": ("serial:p:s", "b", False),
        "b": ("serial:p:s", "b", True),
        "c": ("usb:u:unit:0", "c", False),
        "d": ("endpoint:e4", "d", False),
    }
    assert str(got["b"].first_seen) == t(1) and got["d"].first_seen is None


def test_presence_follows_the_last_cycle(spark):
    connections = spark.createDataFrame([("c", "e"), ("c", "f"), ("d", "e")], "controller_id string, endpoint string")
    cycles = spark.createDataFrame([(1, "c", "f"), (2, "c", "e"), (2, "c", "e")], "cycle long, controller_id string, endpoint string")
    active = lambda c: {tuple(r) for r in identity.presence(connections, c).where("active").select("controller_id", "endpoint").collect()}
    assert active(cycles) == {("c", "e")} and active(cycles.where("false")) == set()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared.shared_dir(Session())
