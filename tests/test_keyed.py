"""Machines over streams, and appending from a stream."""

from datetime import datetime, timedelta
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from gridlore.streaming import keyed, sink

START = datetime(2024, 1, 1)
SCAN = "site long, key string, scan_at timestamp, scan_id long, findings array<struct<fingerprint:string,severity:string,confidence:double,title:string,summary:string>>"
EVENT = "device_id long, observed_at timestamp, event_id long, kind string"


def at(hours):
    return START + timedelta(hours=hours)


def run(spark, tmp_path, batches, schema, machine):
    """Rows that a machine makes of batches of rows, a file and a micro-batch each."""
    folder = str(tmp_path / uuid4().hex)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{n:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = machine(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(f"{folder}/out").collect(), held


def finding(name, severity="warning", title="t"):
    return (name, severity, 0.5, title, None)


def test_incidents_open_update_resolve_and_expire(spark, tmp_path):
    batches = [
        [(1, "k", at(2), 3, [finding("a", title="new")]), (1, "k", at(0), 1, [finding("a"), finding("b")]), (1, "k", at(1), 2, [finding("a"), finding("b")]), (1, "other", at(0), 1, [finding("z")])],
        [(1, "k", at(3), 4, None), (1, "k", at(4), 5, [finding("a", "critical")])],
        [(2, "later", at(100), 6, [finding("q")])],
        [(2, "later", at(101), 7, [finding("q")])],
    ]
    rows, held = run(spark, tmp_path, batches, SCAN, lambda s: keyed.incidents(s, ["site", "key"], ttl_s=50 * 3600))
    got = sorted((r.key, r.fingerprint, r.scan_id or 99, r.transition, r.severity, r.occurrences) for r in rows)
    assert got == [
        ("k", "a", 1, "opened", "warning", 1),
        ("k", "a", 3, "updated", "warning", 3),
        ("k", "a", 4, "resolved", "warning", 3),
        ("k", "a", 5, "opened", "critical", 1),
        ("k", "a", 99, "expired", "critical", 1),
        ("k", "b", 1, "opened", "warning", 1),
        ("k", "b", 3, "resolved", "warning", 2),
        ("later", "q", 6, "opened", "warning", 1),
        ("other", "z", 1, "opened", "warning", 1),
        ("other", "z", 99, "expired", "warning", 1),
    ]
    assert max(held) >= 2 and held[-1] == 1  # the store keeps only the key that is alive


def test_a_device_lives_through_its_states(spark, tmp_path):
    kinds = ["discovered", "connecting", "success", "failure", "failure", "failure", "discovered", "success", "missing", "connecting", "missing", "moved", "discovered"]
    batches = [[(1, at(n), n, k) for n, k in enumerate(kinds[:6])], [(1, at(n + 6), n + 6, k) for n, k in enumerate(kinds[6:])], [(2, at(500), 50, "failure")], [(2, at(501), 51, "failure")]]
    rows, held = run(spark, tmp_path, batches, EVENT, lambda s: keyed.lifecycle(s, ["device_id"], ttl_s=100 * 3600))
    got = [(r.state, r.failures, r.reconnects, r.moves, r.offline_since_ms is not None, r.retry_s) for r in sorted(rows, key=lambda r: r.event_id if r.event_id is not None else 40) if r.device_id == 1]
    assert got == [
        ("discovered", 0, 0, 0, False, 0),
        ("connecting", 0, 0, 0, False, 0),
        ("online", 0, 0, 0, False, 0),
        ("degraded", 1, 0, 0, False, 1),
        ("degraded", 2, 0, 0, False, 2),
        ("offline", 3, 0, 0, True, 4),
        ("connecting", 3, 0, 0, True, 0),
        ("online", 0, 1, 0, False, 0),
        ("rediscovering", 0, 1, 0, True, 0),
        ("connecting", 0, 1, 0, True, 0),
        ("rediscovering", 0, 1, 0, True, 0),
        ("connecting", 0, 1, 1, True, 0),
        ("discovered", 0, 1, 1, True, 0),
        ("forgotten", 0, 1, 1, True, 0),
    ]
    assert held[-1] == 1


POLL = (
    "sample_id long, device_id long, observed_at timestamp, latency_ms double, profile string, error string, "
    "values array<struct<name:string,address:int,function:string,raw:array<int>,number:double,flag:boolean,text:string,unit:string>>"
)
VALUES = [("v", 1, "holding", [1, 2], 1.5, None, None, "V"), ("f", 2, "coil", [0], None, False, None, None), ("s", 3, "holding", [], None, None, "word", None), ("n", 4, "holding", None, None, None, None, None)]


def polls(spark, first):
    return spark.createDataFrame([(first, 1, at(0), 2.0, "p", None, VALUES), (first + 1, 1, at(1), None, None, "x" * 1500, None), (first + 2, 2, at(1), 1.0, "p", None, None)], POLL)


def counts(spark, root):
    return {n: sink.appended(spark, root, n).count() for n in sink.TABLES}


def test_a_batch_counts_once_and_as_a_whole(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    sink.write_batch(polls(spark, 0), 0, root)
    once = counts(spark, root)
    assert once == {"samples": 2, "register_values": 4, "poll_errors": 1}
    sink.write_batch(polls(spark, 0), 0, root)
    assert counts(spark, root) == once
    with monkeypatch.context() as m:
        m.setattr(sink, "TABLES", sink.TABLES)
        m.setattr(sink, "split_polls", lambda p, real=sink.split_polls: {k: v if k != "poll_errors" else v.withColumn("error", F.expr("raise_error('down')")) for k, v in real(p).items()})
        with pytest.raises(Exception, match="down"):
            sink.write_batch(polls(spark, 10), 1, root)
    assert counts(spark, root) == once  # samples of the torn batch are there, but nobody sees them
    sink.write_batch(polls(spark, 10), 1, root)
    assert counts(spark, root) == {k: 2 * v for k, v in once.items()}
    values = {r.register_name: (r.raw_json, r.numeric_value, r.text_value) for r in sink.appended(spark, root, "register_values").where("sample_id = 0").collect()}
    assert values == {"v": ("[1,2]", 1.5, None), "f": ("[0]", None, "False"), "s": ("[]", None, "word"), "n": (None, None, None)}
    status = {r.device_id: (r.status, len(r.last_error or ""), r.last_seen) for r in sink.device_status(*(sink.appended(spark, root, n) for n in ("samples", "poll_errors"))).collect()}
    assert status == {1: ("error", 1000, at(0)), 2: ("online", 0, at(1))}


def test_the_stream_goes_on_where_it_stopped(spark, tmp_path):
    root, source = f"file://{tmp_path}/out", f"{tmp_path}/in"
    for n in range(3):
        polls(spark, n * 10).coalesce(1).write.mode("append").parquet(source)
        sink.append_polls(spark.readStream.schema(POLL).parquet(source), root).awaitTermination()
        assert counts(spark, root)["samples"] == 2 * (n + 1)
