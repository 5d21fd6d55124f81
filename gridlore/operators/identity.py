"""Who a controller is: registration of observations, stronger identities, immutable ids, presence.

Blank texts count as unknown throughout.  Null times sort first, and ties in time are broken by the id named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.sources.shared import materialise


def said(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def identity(profile: Column, serial: Column, usb_serial: Column, unit: Column, endpoint: Column) -> Column:
    """(controller_id, source, value): from the serial number, else adapter and unit, else the endpoint."""
    made = lambda key, name, value: F.struct(key.alias("controller_id"), F.lit(name).alias("source"), value.alias("value"))
    by_serial = F.concat(F.lit("serial:"), F.lower(F.coalesce(F.trim(profile), F.lit(""))), F.lit(":"), F.lower(said(serial)))
    by_usb = F.concat(F.lit("usb:"), F.lower(said(usb_serial)), F.lit(":unit:"), F.coalesce(unit, F.lit(0)).cast("string"))
    return (
        F.when(said(serial).isNotNull(), made(by_serial, "controller_serial", said(serial)))
        .when(said(usb_serial).isNotNull(), made(by_usb, "usb_serial", said(usb_serial)))
        .otherwise(made(F.concat(F.lit("endpoint:"), endpoint), "endpoint", endpoint))
    )


def settled(redirects: DataFrame) -> DataFrame:
    """(old, new) with every new at the end of its chain, however long, by pointer jumping.

    redirects has one row for each old; a row to itself says nothing.  Chains that form a ring have no end: ValueError.
    """
    now = materialise(redirects.select("old", "new").where("old <> new"))
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("old").alias("via"), F.col("new").alias("target"))
        stepped = now.join(ahead, F.col("new") == F.col("via"), "left")
        later = materialise(stepped.select("old", F.coalesce("target", "new").alias("new"), F.col("target").isNotNull().alias("moved")))
        if not later.where("moved").take(1):
            return now
        if later.where("old = new").take(1):
            break
        now = later.drop("moved")
    raise ValueError("redirects form a ring")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b); a component is called by its smallest node.

    Every node turns to its smallest neighbour, chains of turns are settled, and edges shrink to what joins different
    groups.  Each round at least halves the groups that still have a neighbour.
    """
    left = materialise(edges.select("a", "b").where("a is not null and b is not null").distinct())
    known = materialise(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node")))
    while True:
        left = left.where("a <> b")
        if not left.take(1):
            return known
        both = left.union(left.select("b", "a")).toDF("old", "b")
        turns = both.groupBy("old").agg(F.min("b").alias("new")).where("new < old")
        moved = settled(turns)
        renamed = lambda df, c: df.join(moved, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")  # noqa: E731, B023
        known = materialise(renamed(known, "component"))
        left = materialise(renamed(renamed(left, "a"), "b").distinct())


#: How sure a match is.
SURE = {"controller_serial": 1.0, "usb_serial": 0.8, "endpoint": 0.8, "controller_serial_conflict": 0.95, "controller_serial_promotion": 1.0, "new_controller": 0.4}
OWNER_WITH_SERIAL, OWNER_WITHOUT_SERIAL = 0.95, 0.65


def conflict_device_id(profile: str, serial: str, endpoint: str) -> str:
    """The id of a device that takes an endpoint over from another."""
    return f"device:{profile}:{hashlib.sha256('\0'.join((profile, serial, endpoint)).encode()).hexdigest()[:20]}"


@dataclass
class Registry:
    """What is registered in one component: identities, and the controller last seen at each endpoint."""

    #: controller_id: [canonical device, serial number].
    identities: dict[str, list[str]] = field(default_factory=dict)
    owner: dict[str, str] = field(default_factory=dict)
    #: Endpoints of each owner.
    places: dict[str, set[str]] = field(default_factory=dict)

    def register(self, controller_id: str, source: str, profile: str, serial: str, endpoint: str, device_id: str) -> tuple[str, str, str, float]:
        """(controller_id, canonical device, strategy, confidence) of the next observation."""
        owner = self.owner.get(endpoint)
        sure = SURE.get(source, 0.8)
        strategy = source
        if controller_id not in self.identities:
            if owner is None:
                strategy, sure = "new_controller", SURE["new_controller"]
                self.identities[controller_id] = [device_id, serial]
            else:
                device, known = self.identities[owner]
                if serial and not known:
                    strategy, sure = "controller_serial_promotion", SURE["controller_serial_promotion"]
                    self.identities[controller_id] = [device, serial]
                    del self.identities[owner]
                    for place in self.places.pop(owner):
                        self._own(place, controller_id)
                elif serial and serial != known:
                    strategy, sure = "controller_serial_conflict", SURE["controller_serial_conflict"]
                    self.identities[controller_id] = [conflict_device_id(profile, serial, endpoint), serial]
                else:
                    strategy, sure = "known_endpoint_owner", OWNER_WITH_SERIAL if known else OWNER_WITHOUT_SERIAL
                    controller_id = owner
        now = self.identities[controller_id]
        now[1] = serial or now[1]
        if self.owner.get(endpoint) != controller_id:
            if endpoint in self.owner:
                self.places.get(self.owner[endpoint], set()).discard(endpoint)
            self._own(endpoint, controller_id)
        return controller_id, now[0], strategy, sure

    def _own(self, endpoint: str, controller_id: str) -> None:
        self.owner[endpoint] = controller_id
        self.places.setdefault(controller_id, set()).add(endpoint)


REGISTERED = "controller_id string, canonical_device_id string, match_strategy string, match_confidence double"


def registrations(observations: DataFrame) -> DataFrame:
    """Observations with the controller that each is taken for, and why: matched, promoted, in conflict, known by its endpoint or new.

    observations has (sample_id, observed_at, profile, serial, usb_serial, unit, endpoint, device_id); device_id names the row that an endpoint
    may have from before, else null.  What a match finds depends on what was registered earlier at the
    endpoints and under the keys that it touches, so observations are folded in time within each connected component of endpoints and
    keys.  A component streams through its task; only its registry is held.  Observations without an endpoint are left out.
    """
    who = identity(F.col("profile"), F.col("serial"), F.col("usb_serial"), F.col("unit"), F.col("endpoint"))
    rows = observations.where("endpoint is not null").withColumn("who", who)
    edges = rows.select(F.concat(F.lit("at:"), "endpoint").alias("a"), F.concat(F.lit("is:"), "who.controller_id").alias("b"))
    of = components(edges).where("node like 'at:%'").select(F.substring("node", 4, 1 << 30).alias("endpoint"), "component")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    dealt = (
        rows.join(of, "endpoint")
        .select("component", "sample_id", "observed_at", "who.controller_id", "who.source", blank("profile").alias("profile"), blank("serial").alias("serial"), "endpoint", F.coalesce("device_id", "endpoint").alias("device_id"))
        .repartition("component")
        .sortWithinPartitions("component", "observed_at", "sample_id")
    )
    given = ("controller_id", "source", "profile", "serial", "endpoint", "device_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, registry = None, Registry()
        for batch in batches:
            made = []
            for component, *row in zip(*(batch.column(c).to_pylist() for c in ("component", *given)), strict=True):
                if component != at:
                    at, registry = component, Registry()
                made.append(registry.register(*row))
            columns = zip(*made, strict=True) if made else [[]] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("sample_id"), batch.column("observed_at"), batch.column("endpoint"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]],
                ["sample_id", "observed_at", "endpoint", *[c.split()[0] for c in REGISTERED.split(", ")]],
            )

    kind = {c: dealt.schema[c].dataType.simpleString() for c in ("sample_id", "observed_at", "endpoint")}
    return dealt.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kind.items()) + ", " + REGISTERED)


def rekeyed(rows: DataFrame, moves: DataFrame, key: str = "controller_id") -> DataFrame:
    """Rows under the ids that theirs were promoted to; no row is lost.  moves is settled (old, new), one row an old id."""
    return rows.join(moves.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(key) == F.col("_old"), "left").withColumn(
        key, F.coalesce("_new", key)
    ).drop("_old", "_new")


def merged_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that meet under one id, as one: first and last seen, observations, confidence."""
    return rows.groupBy(*keys).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("observations").alias("observations"),
        F.max("confidence").alias("confidence"),
    )


def bootstrap(devices: DataFrame, now: Column, grace_s: float = 120.0) -> DataFrame:
    """Device rows from before there were identities, under the identity of their group.

    devices has (device_id, profile, serial, usb_serial, unit, endpoint, status, first_seen, last_seen).  The row seen last is the canonical one
    of its group, the greatest id among equals; it alone may be active, and only if it is online or in error and was seen within
    the grace.  first_seen is that of the group.
    """
    who = identity(F.col("profile"), F.col("serial"), F.col("usb_serial"), F.col("unit"), F.col("endpoint"))
    group = Window.partitionBy("controller_id")
    newest = group.orderBy(F.desc_nulls_last("last_seen"), F.desc("device_id"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    alive = F.lower(F.coalesce("status", F.lit("offline"))).isin("online", "error") & (age <= grace_s * 1e6)
    return (
        devices.withColumn("who", who)
        .select("*", "who.controller_id", F.col("who.source").alias("identity_source"), F.col("who.value").alias("identity_value"))
        .withColumn("place", F.row_number().over(newest))
        .select(
            "controller_id",
            F.first("device_id").over(newest).alias("canonical_device_id"),
            "identity_source",
            "identity_value",
            "device_id",
            F.coalesce(F.min("first_seen").over(group), F.max("last_seen").over(group)).alias("first_seen"),
            "last_seen",
            ((F.col("place") == 1) & F.coalesce(alive, F.lit(False))).alias("active"),
        )
    )


def presence(connections: DataFrame, cycles: DataFrame) -> DataFrame:
    """Connections, active where the last complete discovery cycle saw them.

    connections has (controller_id, endpoint), cycles (cycle, controller_id, endpoint) with a row for each sighting.
    """
    last = cycles.agg(F.max("cycle").alias("cycle"))
    seen = cycles.join(last, "cycle", "left_semi").select("controller_id", "endpoint").distinct().withColumn("seen", F.lit(True))
    return connections.join(seen, ["controller_id", "endpoint"], "left").withColumn("active", F.coalesce("seen", F.lit(False))).drop("seen")


def physical(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(controllers, aliases) from all identities ever synchronised: (controller_id, canonical_device_id, first_seen, last_seen).

    Ids that share a canonical device, directly or over others, are one physical controller.  Its uid is a digest of
    the canonical device that was known first (the smallest among equals), so later rows do not change it.  The
    id and device seen last (the greatest among equals) are the current ones, and that id alone is active.
    """
    rows = snapshots.where("controller_id is not null and canonical_device_id is not null")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    of = components(rows.select(node("c:", "controller_id").alias("a"), node("d:", "canonical_device_id").alias("b")))
    ids = rows.groupBy("controller_id", "canonical_device_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    placed = ids.withColumn("node", node("c:", "controller_id")).join(of, "node").drop("node")
    newest = F.struct("last_seen", "controller_id", "canonical_device_id")
    of_all = placed.groupBy("component").agg(
        F.min_by("canonical_device_id", F.struct("first_seen", "canonical_device_id")).alias("root"),
        F.max(newest).alias("now"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    uid = F.concat(F.lit("ctrl_"), F.md5(F.col("root")))
    controllers = of_all.select(
        "component", uid.alias("controller_uid"), F.col("now.canonical_device_id").alias("canonical_device_id"), F.col("now.controller_id").alias("current_controller_id"), "first_seen", "last_seen"
    )
    of_id = placed.groupBy("component", "controller_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    aliases = of_id.join(controllers.select("component", "controller_uid", "current_controller_id"), "component").select(
        "controller_id", "controller_uid", "first_seen", "last_seen", (F.col("controller_id") == F.col("current_controller_id")).alias("active")
    )
    return controllers.drop("component"), aliases


def scopes(identifiers: DataFrame, controllers: DataFrame, aliases: DataFrame, members: DataFrame) -> DataFrame:
    """(identifier, controller_uid, controller_id, canonical_device_id, history_device_ids); an identifier is a uid or an id it ever had.

    The devices of a history are the current id's members (controller_id, device_id, last_seen) in the order of last_seen and id,
    each once, and the canonical one at the end if it is none of them.  Unknown identifiers have no row.
    """
    names = controllers.select(F.col("controller_uid").alias("identifier"), "controller_uid").unionByName(aliases.select(F.col("controller_id").alias("identifier"), "controller_uid"))
    once = members.groupBy("controller_id", "device_id").agg(F.min("last_seen").alias("last_seen"))
    listed = once.groupBy(F.col("controller_id").alias("current_controller_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("last_seen", "device_id"))), lambda m: m["device_id"]).alias("devices")
    )
    devices = F.coalesce("devices", F.array().cast("array<string>"))
    whole = controllers.join(listed, "current_controller_id", "left").withColumn(
        "history_device_ids", F.when(F.array_contains(devices, F.col("canonical_device_id")), devices).otherwise(F.concat(devices, F.array("canonical_device_id")))
    )
    found = identifiers.join(names, "identifier").dropDuplicates(["identifier"])
    return found.join(whole, "controller_uid").select("identifier", "controller_uid", F.col("current_controller_id").alias("controller_id"), "canonical_device_id", "history_device_ids")
