"""Register tables in documents."""

from gridlore.operators import docscan

KIND = "source_id string, page int, text string"


def found(spark, *texts):
    rows = docscan.register_observations(spark.createDataFrame([("s", n + 1, t) for n, t in enumerate(texts)], KIND)).collect()
    return {(r.scope, r.address, r.label): (r.page, r.confidence) for r in rows}


def test_rows_and_the_spaces_they_stand_in(spark):
    assert found(
        spark,
        "RAM\n0x0018 25 battery_voltage Battery Voltage V Float16\nCoils\n0x0018 25 CLEAR_ALARMS Clear alarms; true==do action\n"
        "EEPROM\n0xE000 57345 EV_reg Regulation Voltage V Float16\nLogged Data\n0x8000 logger_0 first log block\n",
    ) == {
        ("runtime", 0x18, "battery_voltage"): (1, 0.95),
        ("control", 0x18, "CLEAR_ALARMS"): (1, 0.95),
        ("configuration", 0xE000, "EV_reg"): (1, 0.95),
        ("log", 0x8000, "logger_0"): (1, 0.95),
    }


def test_prose_is_no_row(spark):
    text = (
        "RAM\nNote: if va_ref_fixed (0x005A) is non-zero, it overrides the setting.\nf16 = (sign == 1) ? 0xfc00 : 0x7c00;\n"
        "0x1000 0000 instead of a fault\n0x005A 91 va_ref_fixed Array V fixed voltage\n0x12 short\n0x00123 long\n0x0013 x\n"
    )
    assert list(found(spark, text)) == [("runtime", 0x5A, "va_ref_fixed")]


def test_spaces_other_than_the_section(spark):
    got = found(
        spark,
        "0x0041 ILOAD_F256_0 Load current A float32\n0x0042 ILOAD_F256_1 Load current A Float32\n0x0043 Reserved\n0x0044 power Set only\n0x0045 Load_Disconnect x\n0x0046 Eqtrig\n0x9000 later x\n0x7FFF name-é x\n0x0047 naïve x",
    )
    assert {k[:2] for k in got} == {
        ("alternate_encoding", 0x41),
        ("alternate_encoding", 0x42),
        ("reserved", 0x43),
        ("control", 0x44),
        ("control", 0x45),
        ("control", 0x46),
        ("runtime", 0x9000),
        ("runtime", 0x7FFF),
    }
    assert got[("runtime", 0x9000, "later")] == (1, 0.85) and ("runtime", 0x7FFF, "name-") in got  # a letter is no end of a word, whatever its script


def test_sections_go_on_over_pages_and_the_surest_row_stays(spark):
    got = found(spark, "EEPROM:\n", None, "", "0x0001 one a\n0x0001 ONE a\nRAM registers of the device\n0x0001 one a", "x" * 97 + " eeprom\n0x0002 two b\n" + "eeprom " + "y" * 90 + "\n0x0003 three c")
    assert got == {
        ("configuration", 1, "one"): (4, 0.85),
        ("runtime", 1, "one"): (4, 0.85),
        ("runtime", 2, "two"): (5, 0.85),
        ("runtime", 3, "three"): (5, 0.85),
    }


def test_no_pages(spark):
    assert docscan.register_observations(spark.createDataFrame([], KIND)).count() == 0
