"""Devices behind the samples: identity, endpoints, life cycle and what is attached to what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def identity_key(serial: Column, usb_serial: Column, unit: Column, endpoint: Column) -> Column:
    """The strongest identity that is known: serial number, adapter and unit, endpoint."""
    said = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("serial:"), said(serial)),
        F.concat(F.lit("usb:"), said(usb_serial), F.lit(":"), unit.cast("string")),
        F.concat(F.lit("endpoint:"), said(endpoint)),
    )


def sightings(log: DataFrame, keys: list[str]) -> DataFrame:
    """What counter-merging upserts would hold, from the whole log of (observed_at, confidence)."""
    return log.groupBy(*keys).agg(
        F.min("observed_at").alias("first_seen"),
        F.max("observed_at").alias("last_seen"),
        F.count("*").alias("observations"),
        F.max("confidence").alias("confidence"),
    )


def preferred_endpoint(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of (endpoint, rank, incumbent) the endpoint in use, else the one of least rank."""
    order = F.struct(~F.coalesce("incumbent", F.lit(False)), "rank", "endpoint")
    return candidates.groupBy(*keys).agg(F.min_by("endpoint", order).alias("endpoint"), F.count("*").alias("candidates"))


def assigned_by_host(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """events with the controller_id of their host, null unless exactly one controller is reached there."""
    hosts = candidates.where("host is not null").groupBy("host").agg(
        F.min("controller_id").alias("least"), F.max("controller_id").alias("most")
    )
    only = F.when(F.col("least") == F.col("most"), F.col("least"))
    return events.join(hosts, "host", "left").withColumn("controller_id", only).drop("least", "most")


def lifecycle(polls: DataFrame, keys: list[str], offline_after: int = 3, first_wait: int = 1, longest_wait: int = 60) -> DataFrame:
    """Status and next wait after each poll of (observed_at, sample_id, success).

    Failures in a row count from the last success; both windows share one shuffle.
    """
    order = ("observed_at", "sample_id")
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(*keys, "successes").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.coalesce("success", F.lit(False))
    failures = F.col("failures")
    return (
        polls.withColumn("successes", F.sum(ok.cast("long")).over(upto))
        .withColumn("failures", F.sum((~ok).cast("long")).over(since))
        .withColumn(
            "status",
            F.when(failures == 0, "online")
            .when(failures >= offline_after, "offline")
            .when(F.col("successes") == 0, "connecting")
            .otherwise("degraded"),
        )
        .withColumn("wait_s", F.least(F.lit(longest_wait).cast("double"), first_wait * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0)))))
    )


def connected_products(values: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Registers connected_product_<slot>_<field> turned into a row a slot; fields is the closed list of columns."""
    name = F.col("register_name")
    pattern = r"^connected_product_(\d+)_(.*)$"
    return (
        values.where(name.rlike(pattern))
        .withColumn("slot", F.regexp_extract(name, pattern, 1).cast("long"))
        .withColumn("field", F.regexp_extract(name, pattern, 2))
        .groupBy(*keys, "slot")
        .pivot("field", fields)
        .agg(F.max("value"))
    )


def component_graph(members: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, kind) and edges (source, target, relation, confidence).

    members has (system_id, controller_id), products (controller_id, slot, serial).  A product whose
    serial is unknown gets an id from its place, and less confidence.
    """
    system = F.concat(F.lit("system:"), F.col("system_id").cast("string"))
    bus = F.concat(F.lit("bus:"), F.col("system_id").cast("string"))
    controller = F.concat(F.lit("controller:"), F.col("controller_id").cast("string"))
    place = F.substring(F.sha2(F.concat_ws("|", "controller_id", "slot"), 256), 1, 20)
    serial = F.nullif(F.lower(F.trim("serial")), F.lit(""))
    product = F.concat(F.lit("product:"), F.coalesce(serial, place))
    known = F.when(serial.isNotNull(), 1.0).otherwise(0.5)
    edge = lambda a, b, name, sure: F.struct(a.alias("source"), b.alias("target"), F.lit(name).alias("relation"), sure.alias("confidence"))
    inner = members.select(F.inline(F.array(edge(controller, system, "member_of", F.lit(1.0)), edge(controller, bus, "charges", F.lit(1.0)))))
    outer = products.select(edge(controller, product, "monitors", known).alias("e")).select("e.*")
    edges = inner.unionByName(outer).groupBy("source", "target", "relation").agg(F.max("confidence").alias("confidence"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return ends.withColumn("kind", F.substring_index("node_id", ":", 1)), edges
