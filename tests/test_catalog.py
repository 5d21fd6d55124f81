"""Small cases of the register catalog that the driver's tables do not have."""

from pyspark.sql import functions as F

from gridlore.operators import catalog

BLOCK = "device_id long, function string, address long, count long, category string, optional boolean"


def test_blocks_need_all_their_words(spark):
    blocks = spark.createDataFrame(
        [(1, "holding", 10, 2, "runtime", False), (1, "input", 10, 2, "runtime", True), (2, "holding", 5, 1, "metadata", False), (2, "holding", 9, 0, "runtime", False)],
        BLOCK,
    )
    words = spark.createDataFrame([(1, "holding", 10), (1, "holding", 10), (1, "holding", 11), (1, "input", 11), (3, "holding", 5)], "device_id long, function string, address long")
    found = catalog.readable_blocks(blocks, words)
    assert {(r.device_id, r.function, r.readable) for r in found.collect()} == {(1, "holding", True), (1, "input", False), (2, "holding", False)}
    devices = spark.createDataFrame([(1, "verified"), (2, "verified"), (3, "probable"), (4, None)], "device_id long, status string")
    report = {r.device_id: r for r in catalog.verification(devices, found).collect()}
    assert [report[d].result for d in (1, 2, 3, 4)] == ["verified", "failed", "verified", "failed"]
    assert (report[1].runtime_readable, report[1].runtime_total, report[1].optional_readable, report[1].optional_total) == (1, 2, 0, 1)
    assert report[3].runtime_total == 0


def test_observations_against_the_catalog(spark):
    observations = spark.createDataFrame(
        [
            ("s", 1, "V", "runtime", 0.9),
            ("s", 5, "Vx", "runtime", 0.9),
            ("s", 5, "vX", "runtime", 0.2),
            ("s", 90, "far", "runtime", 1.0),
            ("s", 2, "gap", "reserved", 0.1),
            ("s", 90, "gap", "reserved", 0.1),
            ("s", 90, "e", "eeprom", 0.1),
            ("s", 90, "n", None, 0.1),
            ("t", 1, "V", "runtime", 0.9),
            (None, 1, "V", "runtime", 0.9),
        ],
        "source_id string, address long, label string, scope string, confidence double",
    )
    profiles = spark.createDataFrame([("p", "s")], "profile string, source_id string")
    registers = spark.createDataFrame([("p", "volt", 1, 2), ("p", "amp", 2, 1), ("p", "none", 90, 0)], "profile string, name string, address long, words long")
    blocks = spark.createDataFrame([("p", 4, 4)], "profile string, address long, count long")
    met = catalog.compared(observations, profiles, registers, blocks)
    changes = {(r.change_type, r.address, r.label, r.confidence, r.declared_names, r.actionable) for r in catalog.proposed_changes(met).collect()}
    assert changes == {
        ("unnamed_field_in_read_block", 5, "Vx", 0.7, None, False),
        ("runtime_address_outside_read_blocks", 90, "far", 0.9, None, False),
        ("declared_register_overlaps_reserved_vendor_row", 2, "gap", 0.95, "amp,volt", True),
    }
    told = {r.reason: r.n for r in catalog.ignored_counts(met).collect()}
    assert told == {"covered_named_register": 1, "reserved": 1, "eeprom": 1, "unknown": 1, "unmapped_source": 2}


def test_intervals_stop_at_the_first_failed_stage(spark):
    rows = [("a", 10.0, True), ("a", 5.0, True), ("a", 5.0, False), ("a", 1.0, True), ("b", 10.0, None), ("c", 10.0, True), ("c", 2.0, True)]
    found = catalog.tuned_interval(spark.createDataFrame(rows, "site string, interval_s double, passed boolean"), ["site"], 60.0)
    assert {r.site: (r.interval_s, r.stopped_at) for r in found.collect()} == {"a": (10.0, 5.0), "b": (60.0, 10.0), "c": (2.0, None)}


def test_gated_items_need_a_version(spark):
    devices = spark.createDataFrame([(1, "p", "v2.1"), (2, "p", "?"), (3, "p", None)], "device_id long, profile string, firmware string")
    items = spark.createDataFrame([("p", "old", None, "2"), ("p", "new", "2.0", None), ("p", "all", None, None)], "profile string, name string, since_firmware string, until_firmware string")
    found = catalog.effective(devices, items).groupBy("device_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    assert {r.device_id: r.names for r in found.collect()} == {1: "all,new", 2: "all", 3: "all"}
