"""Evidence, capabilities, fingerprints and status of devices."""

import pytest
from pyspark.sql import functions as F

from gridlore.operators import evidence

DEVICE = (
    "device_id long, profile string, by_product boolean, vendor_matched boolean, metadata map<string,string>, metadata_error string, firmware string, serial string, "
    "firmware_verified_max string, declared array<string>, transport string"
)
VALUE = "device_id long, register_name string, value double, unit string"


def device(spark, **given):
    base = {"device_id": 1, "profile": "p", "by_product": True, "vendor_matched": True, "metadata": {"model": "x"}, "metadata_error": None, "firmware": "2.1", "serial": "S", "firmware_verified_max": None, "declared": ["alarms"], "transport": "tcp"}
    return spark.createDataFrame([tuple((base | given).values())], DEVICE)


def told(row):
    return round(row.confidence, 4), row.status, row.capabilities, [e.code for e in row.evidence], [w.code for w in row.warnings]


@pytest.mark.parametrize(
    "given, expected",
    [
        ({}, (0.92, "verified", ["alarms", "modbus_tcp"], ["vendor", "product-code", "metadata", "firmware", "serial"], [])),
        ({"by_product": False, "serial": " "}, (0.76, "probable", ["alarms", "modbus_tcp"], ["vendor", "fingerprint", "metadata", "firmware"], [])),
        ({"profile": "generic", "by_product": None, "declared": None, "transport": None}, (0.42, "generic", [], ["vendor", "firmware", "serial"], [])),
        ({"firmware": "2.10", "firmware_verified_max": "2.9", "metadata": None, "metadata_error": "Timeout"}, (0.74, "newer-firmware-unverified", ["alarms", "modbus_tcp"], ["vendor", "product-code", "firmware", "serial"], ["metadata-unavailable", "newer-firmware"])),
        ({"firmware": "none", "firmware_verified_max": "2", "vendor_matched": None, "serial": None}, (0.58, "family-only", ["alarms", "modbus_tcp"], ["product-code", "metadata", "firmware"], [])),
        ({"metadata": {"soc": "1", "load_state": "x", "generator_run": "0", "rts_temp": "1", "battery_sense_voltage": "1"}, "transport": "serial"}, (0.92, "verified", ["alarms", "battery_soc", "battery_voltage_sense", "generator_control", "load_control", "remote_temperature_sensor", "rtu"], ["vendor", "product-code", "metadata", "firmware", "serial"], [])),
    ],
)
def test_resolved(spark, given, expected):
    assert told(evidence.resolved(device(spark, **given)).first()) == expected


def test_values_replace_what_values_told_before(spark):
    once = evidence.resolved(device(spark))
    good = spark.createDataFrame([(1, "volts", 12.0, "V"), (1, "soc", 50.0, "%"), (1, "holding_0x0001", 9e9, "V"), (1, "mode", None, None)], VALUE)
    bad = spark.createDataFrame([(1, "volts", 1200.0, "V"), (1, "temp", float("nan"), "C"), (1, "soc", 50.0, "%")], VALUE)
    fine = evidence.refreshed(once, good, ["device_id"])
    codes = ["vendor", "product-code", "metadata", "firmware", "serial", "named-registers", "telemetry-plausibility"]
    assert told(fine.first()) == (1.0, "verified", ["alarms", "battery_soc", "modbus_tcp"], codes, [])
    ill = evidence.refreshed(fine, bad, ["device_id"])
    assert told(ill.first()) == (0.7, "invalid", ["alarms", "battery_soc", "modbus_tcp"], codes, ["implausible-value", "non-finite"])
    assert told(evidence.refreshed(ill, good, ["device_id"]).first()) == told(fine.first())
    unnamed = evidence.refreshed(ill, good.where("register_name like 'holding%'"), ["device_id"])
    assert told(unnamed.first()) == (0.92, "verified", ["alarms", "modbus_tcp"], codes[:5], [])


def test_probes_in_their_order(spark):
    blocks = {
        1: {3: 5000, 4: 1200, 5: 1100, 6: 50, 13: 120, 14: 60},
        2: {3: 5000, 4: 1200, 5: 1100, 13: 120, 14: 60},
        3: {0x106 + n: w for n, w in enumerate((0, 0, 4, 0, 255, 0))} | {26: 1, 27: 8},
        4: {0x106 + n: w for n, w in enumerate((0, 0, 2, 0, 255, 0))} | {26: 3, 27: 8},
        5: {26: 4, 27: 8},
    }
    words = spark.createDataFrame([(d, a, w) for d, ws in blocks.items() for a, w in ws.items()], "device_id long, address long, word long")
    got = {r.device_id: r.profile for r in evidence.fingerprint(words, ["device_id"]).collect()}
    assert got == {1: "inverter_gen2", 2: "inverter_classic", 3: "dual_controller", 4: "pwm_controller", 5: "generic"}
    plan = evidence.fingerprint(words, ["device_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_metadata_is_sorted(spark):
    row = spark.range(1).select(evidence.sorted_metadata(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("m")).first()
    assert [tuple(x) for x in row.m] == [("a", 2), ("b", 1)]
