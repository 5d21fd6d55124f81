"""The register catalog as data: what applies to a firmware, what could be read, what observations add.

A catalog is a set of small frames that the user supplies: registers (profile, name, address, words),
blocks (profile, function, address, count, category, optional), either with since_firmware and
until_firmware.  Ranges of addresses meet by equality: the catalog's side is spread over its addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlore.functions.text import firmware_allows


def effective(devices: DataFrame, items: DataFrame) -> DataFrame:
    """Items of each device's profile that its firmware has; devices is (device_id, profile, firmware)."""
    allowed = firmware_allows(F.col("firmware"), F.col("since_firmware"), F.col("until_firmware"))
    return devices.join(items, "profile").where(allowed)


def spread(ranges: DataFrame, length: str) -> DataFrame:
    """A row for each address at_address of a range; empty and null ranges have none."""
    last = F.col("address") + F.col(length) - 1
    return ranges.where(F.col(length) > 0).withColumn("at_address", F.explode(F.sequence("address", last)))


def readable_blocks(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks of devices with whether words, (device_id, function, address), has all of their addresses."""
    seen = words.select("device_id", "function", F.col("address").alias("at_address")).distinct().withColumn("seen", F.lit(1))
    wanted = spread(blocks, "count").join(seen, ["device_id", "function", "at_address"], "left")
    return wanted.groupBy("device_id", "function", "address", "count", "category", "optional").agg(
        (F.count("seen") == F.count("*")).alias("readable")
    )


def verification(devices: DataFrame, blocks: DataFrame) -> DataFrame:
    """A report a device, (device_id, status), of its readable_blocks.

    It is verified if all blocks that are not optional could be read and its profile is known; a device
    without blocks misses none.
    """
    readable, metadata = F.col("readable"), F.col("category") == "metadata"
    counted = blocks.groupBy("device_id").agg(
        F.count_if(~metadata & readable).alias("runtime_readable"),
        F.count_if(~metadata).alias("runtime_total"),
        F.count_if(metadata & readable).alias("metadata_readable"),
        F.count_if(metadata).alias("metadata_total"),
        F.count_if(F.col("optional") & readable).alias("optional_readable"),
        F.count_if(F.col("optional")).alias("optional_total"),
        F.count_if(~F.col("optional") & ~readable).alias("missed"),
    )
    known = ~F.coalesce(F.col("status"), F.lit("generic")).isin("generic", "invalid")
    return (
        devices.join(counted, "device_id", "left")
        .na.fill(0, [c for c in counted.columns if c != "device_id"])
        .withColumn("result", F.when((F.col("missed") == 0) & known, "verified").otherwise("failed"))
        .drop("missed")
    )


def compared(observations: DataFrame, profiles: DataFrame, registers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Observations, (source_id, address, label, scope, confidence), against each profile, (profile, source_id), of their source.

    Adds profile, declared_names (comma-joined) and either change_type, with confidence held under the
    type's bound, or the reason why the observation is ignored.
    """
    named = spread(registers, "words").groupBy("profile", "at_address").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("declared_names"))
    read = spread(blocks, "count").select("profile", "at_address").distinct().withColumn("in_block", F.lit(True))
    place = ["profile", "at_address"]
    met = (
        observations.join(profiles, "source_id", "left")
        .withColumn("at_address", F.col("address"))
        .join(named, place, "left")
        .join(read, place, "left")
    )
    declared, reserved, runtime = F.col("declared_names").isNotNull(), F.col("scope").eqNullSafe("reserved"), F.col("scope").eqNullSafe("runtime")
    reason = (
        F.when(F.col("profile").isNull(), "unmapped_source")
        .when(reserved, F.when(~declared, "reserved"))
        .when(~runtime, F.coalesce("scope", F.lit("unknown")))
        .when(declared, "covered_named_register")
    )
    change = F.when(reserved, "declared_register_overlaps_reserved_vendor_row").when(F.col("in_block"), "unnamed_field_in_read_block").otherwise("runtime_address_outside_read_blocks")
    sure = F.when(reserved, 0.95).otherwise(F.least("confidence", F.when(F.col("in_block"), 0.70).otherwise(0.90)))
    return (
        met.withColumn("ignored", reason)
        .withColumn("change_type", F.when(F.col("ignored").isNull(), change))
        .withColumn("confidence", F.when(F.col("ignored").isNull(), sure))
        .drop("at_address", "in_block")
    )


def proposed_changes(comparison: DataFrame) -> DataFrame:
    """Each change once, whatever the case of its label, by its surest observation."""
    order = F.struct("confidence", F.col("label"))
    return (
        comparison.where(F.col("change_type").isNotNull())
        .groupBy("profile", "change_type", "address", F.lower("label").alias("label_key"))
        .agg(
            F.max("confidence").alias("confidence"),
            F.max_by("label", order).alias("label"),
            F.max("declared_names").alias("declared_names"),
        )
        .withColumn("actionable", F.col("change_type") == "declared_register_overlaps_reserved_vendor_row")
        .drop("label_key")
    )


def ignored_counts(comparison: DataFrame) -> DataFrame:
    return comparison.where(F.col("ignored").isNotNull()).groupBy(F.col("ignored").alias("reason")).agg(F.count("*").alias("n"))


def tuned_interval(verdicts: DataFrame, keys: list[str], fallback_s: float) -> DataFrame:
    """The fastest interval before the first stage that fails, from (interval_s, passed) of each stage and controller.

    Stages go from slow to fast; a stage fails with any of its controllers, and with a verdict that is null.
    """
    failed = F.max(F.when(~F.coalesce("passed", F.lit(False)), F.col("interval_s")))
    stages = verdicts.groupBy(*keys, "interval_s").agg(F.min(F.coalesce("passed", F.lit(False))).alias("passed"))
    return (
        stages.groupBy(*keys)
        .agg(failed.alias("stopped_at"), F.array_sort(F.collect_list("interval_s")).alias("intervals"))
        .withColumn("safe", F.filter("intervals", lambda i: F.col("stopped_at").isNull() | (i > F.col("stopped_at"))))
        .withColumn("interval_s", F.coalesce(F.array_min("safe"), F.lit(fallback_s)))
        .drop("intervals", "safe")
    )
