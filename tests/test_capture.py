"""Capture bundles without identifiers, and the gates of proposals."""

import json

import pytest
from pyspark.sql import functions as F

from gridlore.operators import gates
from gridlore.sources import capture

DEVICE = "device_id long, profile string, firmware string, status string, confidence double, serial_number string, endpoint struct<target:string,port:int,usb_serial:string>, raw_objects array<int>, links array<struct<target:string,n:int>>"
VALUE = "device_id long, register_name string, value string"
EXCHANGE = "device_id long, function_code int, response_pdu_hex string"


@pytest.fixture(scope="module")
def parts(spark):
    devices = spark.createDataFrame([(1, "p", "1.0", "verified", 0.9, "SN1", ("10.0.0.1", 502, "U1"), [1], [("10.0.0.1", 1), (None, 2)]), (2, "p", None, "generic", 0.1, None, None, None, None)], DEVICE)
    values = spark.createDataFrame([(1, "serial_number", "SN1"), (1, "volts", "12"), (1, "holding_0x0001", "7"), (2, "serial", None)], VALUE)
    return devices, values, spark.createDataFrame([(1, 3, "0304"), (1, 3, None)], EXCHANGE)


def test_a_bundle_tells_no_identifier_and_can_be_checked(spark, tmp_path, parts):
    path = f"file://{tmp_path}/bundle"
    capture.write_bundle(path, *parts)
    text = "".join(f.read_text() for f in (tmp_path / "bundle").rglob("*.json"))
    assert not any(word in text for word in ("SN1", "10.0.0.1", "U1"))
    one = json.loads(next(line for line in "\n".join(f.read_text() for f in (tmp_path / "bundle" / "identification").rglob("*.json")).splitlines() if '"device_id":1' in line))
    assert one["endpoint"] == {"target": "<redacted>", "port": 502, "usb_serial": "<redacted>"} and one["raw_objects"] is None
    assert one["links"] == [{"target": "<redacted>", "n": 1}, {"target": None, "n": 2}]
    told = {(r.device_id, r.part): r.n for r in capture.read_manifest(spark, path).collect()}
    assert told == {(1, "identification"): 1, (2, "identification"): 1, (1, "registers"): 3, (2, "registers"): 1, (1, "transactions"): 2, (1, "expected"): 1, (2, "expected"): 1}
    devices, values, exchanges = parts
    schemas = {"identification": devices.schema, "registers": values.schema, "transactions": exchanges.schema, "expected": capture.expected(devices, values).schema}
    assert capture.damaged(spark, path, schemas).count() == 0
    exchanges.limit(1).write.mode("overwrite").json(f"{path}/transactions")
    assert [tuple(r) for r in capture.damaged(spark, path, schemas).collect()] == [(1, "transactions")]
    wanted = {r.device_id: r.named_registers for r in capture.expected(devices, values).collect()}
    assert wanted == {1: ["serial_number", "volts"], 2: ["serial"]}


def test_pseudonyms_are_equal_in_equal_places(parts):
    devices, values, _ = parts
    row = capture.without_identifiers(devices, key="k").where("device_id = 1").first()
    other = capture.without_identifiers(devices, key="l").where("device_id = 1").first()
    serial = capture.redacted_registers(values, "k").where("register_name = 'serial_number'").first().value
    assert row.endpoint.target == row.links[0].target != other.endpoint.target and row.serial_number == serial
    assert row.serial_number.startswith("id:") and row.links[1].target is None
    assert capture.without_identifiers(devices, names=()).collect() == devices.collect()


GOOD = {"source_id": "s", "source_sha256": "a" * 64, "affected_profiles": ["p"], "changes": [1], "tests": ["t"]}


@pytest.mark.parametrize(
    "content, errors",
    [
        (json.dumps(GOOD), []),
        ("{", ["invalid proposal JSON"]),
        (None, ["invalid proposal JSON"]),
        (json.dumps(GOOD | {"source_id": " ", "source_sha256": "a" * 63, "tests": "t"}), ["source_id must be non-empty", "source_sha256 must be a 64-character SHA-256 digest", "tests must be a non-empty list"]),
        (json.dumps({k: v for k, v in GOOD.items() if k != "changes"}), ["missing required key(s): changes", "changes must be a non-empty list"]),
    ],
)
def test_proposals(spark, content, errors):
    assert spark.createDataFrame([(content,)], "c string").select(gates.proposal_errors(F.col("c"))).first()[0] == errors


def test_changes_of_the_catalog_need_proposals_and_tests(spark):
    rows = [("a", "catalog/x"), ("b", "catalog/x"), ("b", "proposals/1.json"), ("b", "tests/t"), ("c", "docs/x"), ("d", "catalog/x"), ("d", "proposals/2.json"), ("e", "catalog/x"), ("e", "proposals/gone.json"), ("e", "tests/t")]
    changes = spark.createDataFrame(rows, "change_id string, path string")
    proposals = spark.createDataFrame([("proposals/1.json", json.dumps(GOOD)), ("proposals/2.json", "[")], "path string, content string")
    got = {r.change_id: r.errors for r in gates.review(changes, proposals, ("catalog/",), "proposals/", "tests/").collect()}
    need = "changes of the catalog or its sources need a "
    assert got == {"a": [f"{need}reviewed proposal", f"{need}change of the tests"], "b": [], "c": [], "d": [f"{need}change of the tests", "proposals/2.json: invalid proposal JSON"], "e": ["proposals/gone.json: invalid proposal JSON"]}
