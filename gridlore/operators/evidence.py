"""What is known of a device: the profile that its registers fit, evidence for it, capabilities, warnings and status.

Evidence is an array of (code, detail, weight, passed), warnings one of (code, detail, severity).  All of it is one row a
device, so nothing but the words and values of a device is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridlore.functions.text import padded, version_parts
from gridlore.operators.site import ENVELOPE

EVIDENCE = "array<struct<code:string,detail:string,weight:double,passed:boolean>>"
WARNING = "array<struct<code:string,detail:string,severity:string>>"

#: Weights of evidence.
WEIGHT = {"vendor": 0.28, "product-code": 0.32, "fingerprint": 0.22, "metadata": 0.18, "firmware": 0.08, "serial": 0.06, "named-registers": 0.08}
PLAUSIBLE, IMPLAUSIBLE = 0.12, 0.30
DYNAMIC_EVIDENCE, DYNAMIC_WARNINGS = ("named-registers", "telemetry-plausibility"), ("non-finite", "implausible-value")

#: Probes in their order; each is a block of words (address, count) and what they have to be.
PROBES = {
    "inverter_gen2": (0x0003, 4, lambda w: w[0].between(1000, 30000) & w[1].between(1000, 6000) & w[2].between(900, 2600) & w[3].between(45, 65)),
    "inverter_classic": (0x000D, 2, lambda w: w[0].between(90, 260) & w[1].between(45, 65)),
    "dual_controller": (0x0106, 6, lambda w: w[2].isin(1, 3, 4) & (w[4] <= 0x00FF)),
    "pwm_controller": (0x001A, 2, lambda w: w[0].isin(0, 1, 2, 3) & w[1].between(0, 8)),
}


def fingerprint(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, profile): the first probe whose block was read whole and fits, else generic.

    words has (keys, address, word), holding registers; of an address that stands several times the greatest word counts.  The words that probes
    look at are turned into columns in one pass, so no probe needs a join.
    """
    wanted = sorted({a + n for a, size, _ in PROBES.values() for n in range(size)})
    wide = words.groupBy(*keys).agg(*[F.max(F.when(F.col("address") == a, F.col("word"))).alias(f"w{a}") for a in wanted])
    found = F.lit("generic")
    for name, (address, size, fits) in reversed(PROBES.items()):
        block = [F.col(f"w{address + n}") for n in range(size)]
        whole = F.lit(True)
        for w in block:
            whole = whole & w.isNotNull()
        found = F.when(whole & fits(block), name).otherwise(found)
    return wide.select(*keys, found.alias("profile"))


def item(code: str, detail: Column | str, weight: float, passed: bool = True) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(code).alias("code"), text.alias("detail"), F.lit(weight).alias("weight"), F.lit(passed).alias("passed"))


def listed(kind: str, *when: tuple[Column, Column]) -> Column:
    """The structs whose condition holds, in order."""
    every = F.array(*[F.when(F.coalesce(c, F.lit(False)), s) for c, s in when])
    return F.filter(every, lambda x: x.isNotNull()).cast(kind)


def score(evidence: Column) -> Column:
    """Weights of what passed less those of what failed, between 0 and 1."""
    signed = F.transform(evidence, lambda e: F.when(e["passed"], e["weight"]).otherwise(-F.abs(e["weight"])))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(signed, F.lit(0.0), lambda a, x: a + x))), 9)


def replaced(items: Column, fresh: Column, codes: tuple[str, ...]) -> Column:
    """Items without those of the codes, in their order, and then the fresh ones."""
    return F.concat(F.filter(items, lambda e: ~e["code"].isin(*codes)), fresh)


def sorted_metadata(values: Column) -> Column:
    """A map as (key, value) pairs in the order of keys."""
    return F.array_sort(F.map_entries(values))


def newer(version: Column, verified: Column) -> Column:
    """Whether a version with numbers lies beyond the verified one."""
    parts, limit = version_parts(version), version_parts(verified)
    return F.coalesce((F.size(parts) > 0) & (F.size(limit) > 0) & (padded(parts, limit) > padded(limit, parts)), F.lit(False))


#: Rungs of a status.
SURE, LIKELY = 0.85, 0.60


def status(profile: Column, confidence: Column, firmware: Column, verified: Column, warnings: Column) -> Column:
    return (
        F.when(profile == "generic", "generic")
        .when(F.exists(warnings, lambda w: w["severity"] == "error"), "invalid")
        .when(newer(firmware, verified), "newer-firmware-unverified")
        .when(confidence >= SURE, "verified")
        .when(confidence >= LIKELY, "probable")
        .otherwise("family-only")
    )


#: Registers that tell of a capability; a name that ends in _ is a prefix.
CAPABILITY_OF = {
    "battery_soc": ("battery_soc", "soc"),
    "load_control": ("load_state",),
    "generator_control": ("generator_",),
    "remote_temperature_sensor": ("rts_temp",),
    "battery_voltage_sense": ("battery_sense_voltage",),
}


def capabilities(declared: Column, transport: Column, names: Column) -> Column:
    """Those of the profile, of the transport (null: not known) and of the registers that are there, in order."""
    has = lambda r: F.exists(names, lambda n: n.startswith(r)) if r.endswith("_") else F.array_contains(names, r)
    told = [F.when(F.coalesce(*[F.nullif(has(r), F.lit(False)) for r in registers], F.lit(False)), name) for name, registers in CAPABILITY_OF.items()]
    by_wire = F.when(transport.isNotNull(), F.when(transport == "tcp", "modbus_tcp").otherwise("rtu"))
    every = F.concat(F.coalesce(declared, F.array().cast("array<string>")), F.array(by_wire, *told))
    return F.array_sort(F.array_distinct(F.filter(every, lambda c: c.isNotNull())))


def resolved(devices: DataFrame) -> DataFrame:
    """Adds confidence, status, capabilities, evidence and warnings to a row a device.

    devices has profile, by_product (the product code named it), vendor_matched, metadata (a map, null where it could not be read; ``metadata_error``
    says why), firmware, serial, firmware_verified_max, declared (capabilities of the profile) and transport.
    """
    c = F.col
    known, said = c("profile") != "generic", lambda name: F.coalesce(F.trim(name), F.lit("")) != ""
    named = known & c("by_product")
    evidence = listed(
        EVIDENCE,
        (c("vendor_matched"), item("vendor", "vendor identity matched", WEIGHT["vendor"])),
        (named, item("product-code", "product code matched catalog aliases", WEIGHT["product-code"])),
        (known & ~F.coalesce("by_product", F.lit(False)), item("fingerprint", "register fingerprint matched", WEIGHT["fingerprint"])),
        (known & (F.size("metadata") > 0), item("metadata", "metadata registers decoded", WEIGHT["metadata"])),
        (said("firmware"), item("firmware", "firmware revision resolved", WEIGHT["firmware"])),
        (said("serial"), item("serial", "serial number resolved", WEIGHT["serial"])),
    )
    warn = lambda code, detail, severity: F.struct(F.lit(code).alias("code"), detail.alias("detail"), F.lit(severity).alias("severity"))
    beyond = newer(c("firmware"), c("firmware_verified_max"))
    warnings = listed(
        WARNING,
        (known & c("metadata_error").isNotNull(), warn("metadata-unavailable", F.concat(F.lit("metadata could not be read: "), "metadata_error"), "info")),
        (beyond, warn("newer-firmware", F.concat(F.lit("firmware "), "firmware", F.lit(" is newer than verified "), "firmware_verified_max"), "warning")),
    )
    names = F.coalesce(F.map_keys("metadata"), F.array().cast("array<string>"))
    told = devices.withColumn("evidence", evidence).withColumn("warnings", warnings)
    return rated(told.withColumn("capabilities", capabilities(c("declared"), c("transport"), names)))


def rated(devices: DataFrame) -> DataFrame:
    """Adds confidence and status from evidence and warnings."""
    sure = devices.withColumn("confidence", score(F.col("evidence")))
    return sure.withColumn("status", status(*[F.col(c) for c in ("profile", "confidence", "firmware", "firmware_verified_max", "warnings")]))


def validation(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fresh, issues, names): evidence and warnings from decoded values (keys, register_name, value, unit), undefined registers left out.

    value is a double, null for texts; infinite and not-a-number values are not finite.
    """
    v, unit = F.col("value"), F.col("unit")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    out = F.lit(False)
    for name, (low, high) in ENVELOPE.items():
        out = out | ((unit == name) & ~v.between(low, high))
    counted = (
        values.where(~F.col("register_name").startswith("holding_0x") & ~F.col("register_name").startswith("input_0x"))
        .withColumn("wrong", F.when(F.coalesce(odd, F.lit(False)), "non-finite").when(F.coalesce(out, F.lit(False)), "implausible-value"))
        .groupBy(*keys)
        .agg(
            F.count("wrong").alias("n_wrong"),
            F.array_sort(F.collect_set(F.when(F.col("wrong").isNotNull(), F.struct(F.col("wrong").alias("code"), F.col("register_name").alias("detail"), F.lit("error").alias("severity"))))).cast(WARNING).alias("issues"),
            F.array_sort(F.collect_set("register_name")).alias("names"),
        )
    )
    wrong = F.concat(F.col("n_wrong").cast("string"), F.lit(" decoded value(s) failed plausibility checks"))
    judged = F.when(F.col("n_wrong") > 0, item("telemetry-plausibility", wrong, IMPLAUSIBLE, False)).otherwise(
        item("telemetry-plausibility", F.lit("decoded values are plausible"), PLAUSIBLE)
    )
    fresh = F.array(item("named-registers", F.lit("named catalog registers decoded"), WEIGHT["named-registers"]), judged)
    return counted.select(*keys, fresh.cast(EVIDENCE).alias("fresh"), "issues", "names")


def refreshed(devices: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Devices with evidence, warnings, capabilities, confidence and status brought up to date by a poll's values.

    What values told before is replaced, all other evidence stays; a device without named values loses it.
    """
    found = devices.join(validation(values, keys), keys, "left")
    none = lambda kind: F.array().cast(kind)
    told = (
        found.withColumn("evidence", replaced(F.col("evidence"), F.coalesce("fresh", none(EVIDENCE)), DYNAMIC_EVIDENCE))
        .withColumn("warnings", replaced(F.col("warnings"), F.coalesce("issues", none(WARNING)), DYNAMIC_WARNINGS))
        .withColumn("capabilities", capabilities(F.col("declared"), F.col("transport"), F.coalesce("names", none("array<string>"))))
    )
    return rated(told.drop("fresh", "issues", "names"))
