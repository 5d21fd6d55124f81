"""Capture bundles: recorded exchanges, registers and what is known of devices, without their identifiers.

A bundle is a folder with one JSON line table for each part, written by as many tasks as the data has, and a manifest that is written
last: a row for each device and part with its count and digest.  A folder without a manifest is no bundle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

VERSION = 1
REDACTED = "<redacted>"
#: Fields that tell who or where a device is, and registers whose values do.
IDENTIFIERS = ("target", "usb_serial", "serial_number", "raw_objects", "raw_pdu_hex")
SERIAL_REGISTERS = ("serial", "serial_number")
PARTS = ("identification", "registers", "transactions", "expected")


def pseudonym(text: Column, key: str | None) -> Column:
    """What stands for an identifier: a mark, or with a key a digest that is equal in equal places.  Null stays null."""
    made = F.lit(REDACTED) if key is None else F.concat(F.lit("id:"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), text), 256), 1, 20))
    return F.when(text.isNotNull(), made)


def hidden(value: Column, kind: DataType, name: str, names: tuple[str, ...], key: str | None) -> Column:
    """A value of any nested type with the fields of these names replaced: texts by pseudonyms, all else by null."""
    if name in names:
        return pseudonym(value, key) if kind.typeName() == "string" else F.lit(None).cast(kind)
    if isinstance(kind, StructType):
        inner = F.struct(*[hidden(value[f.name], f.dataType, f.name, names, key).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(value, lambda x: hidden(x, kind.elementType, "", names, key))
    return value


def without_identifiers(df: DataFrame, names: tuple[str, ...] = IDENTIFIERS, key: str | None = None) -> DataFrame:
    return df.select(*[hidden(F.col(f"`{f.name}`"), f.dataType, f.name, names, key).alias(f.name) for f in df.schema.fields])


def redacted_registers(values: DataFrame, key: str | None = None) -> DataFrame:
    """Values (device_id, register_name, value) with those of serial numbers replaced."""
    return values.withColumn("value", F.when(F.col("register_name").isin(*SERIAL_REGISTERS), pseudonym(F.col("value"), key)).otherwise(F.col("value")))


def expected(devices: DataFrame, values: DataFrame) -> DataFrame:
    """What a replay of the bundle has to find: (device_id, profile, firmware, status, confidence, named_registers)."""
    named = values.where(~F.col("register_name").startswith("holding_0x") & ~F.col("register_name").startswith("input_0x"))
    names = named.groupBy("device_id").agg(F.array_sort(F.collect_set("register_name")).alias("named_registers"))
    none = F.array().cast("array<string>")
    told = devices.select("device_id", "profile", "firmware", "status", "confidence").join(names, "device_id", "left")
    return told.withColumn("named_registers", F.coalesce("named_registers", none))


def digests(part: str, df: DataFrame) -> DataFrame:
    """(device_id, part, n, digest): counts and digests that do not depend on order or files."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.groupBy("device_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64(text).cast("decimal(28,0)")).cast("string").alias("digest")).withColumn("part", F.lit(part))


def write_bundle(path: str, devices: DataFrame, values: DataFrame, exchanges: DataFrame, include_identifiers: bool = False, key: str | None = None) -> None:
    """Write the bundle of these devices, (device_id, profile, firmware, status, confidence, ...), their values and their exchanges.

    Raw exchanges are kept as they are, as a replay needs them; the manifest says so.
    """
    shown = (lambda df: df) if include_identifiers else (lambda df: without_identifiers(df, key=key))
    parts = {
        "identification": shown(devices),
        "registers": values if include_identifiers else redacted_registers(values, key),
        "transactions": exchanges,
        "expected": expected(devices, values),
    }
    spark = devices.sparkSession
    for name, df in parts.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
    held = [digests(name, spark.read.schema(df.schema).json(f"{path}/{name}")) for name, df in parts.items()]
    manifest = held[0]
    for more in held[1:]:
        manifest = manifest.unionByName(more)
    told = {"schema_version": F.lit(VERSION), "identifiers_included": F.lit(include_identifiers), "raw_transactions_may_identify": F.lit(True)}
    manifest.withColumns(told).write.mode("overwrite").json(f"{path}/manifest")


MANIFEST = "device_id long, part string, n long, digest string, schema_version int, identifiers_included boolean, raw_transactions_may_identify boolean"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def damaged(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> DataFrame:
    """(device_id, part) whose rows are not those that the manifest tells of; schemas are those of the parts."""
    found = None
    for name in PARTS:
        one = digests(name, spark.read.schema(schemas[name]).json(f"{path}/{name}"))
        found = one if found is None else found.unionByName(one)
    told = read_manifest(spark, path).select("device_id", "part", F.col("n").alias("told_n"), F.col("digest").alias("told_digest"))
    both = told.join(found, ["device_id", "part"], "full_outer")
    return both.where(~(F.col("n").eqNullSafe(F.col("told_n")) & F.col("digest").eqNullSafe(F.col("told_digest")))).select("device_id", "part")
