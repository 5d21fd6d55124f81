"""Machines over keyed streams: incidents of repeated scans and the life cycle of devices.

A machine is a function of (state, row) that changes the state, a dict of plain values, and returns what the row brings about.
Spark keeps a key's state as JSON.  A key that is silent for ``ttl_s`` seconds of event time ends: ``expire`` says
what that brings about, and its state goes, so the store holds only keys that are alive.  Within a micro-batch the rows
of a key are taken in the order of ``order``; rows behind the watermark are still taken, after what came before them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Row = dict[str, object]
Step = Callable[[dict, Row], list[Row]]


def folded(
    stream: DataFrame,
    keys: list[str],
    order: list[str],
    step: Step,
    made: str,
    expire: Callable[[dict], list[Row]] = lambda state: [],
    ttl_s: int = 30 * 86_400,
    late: str = "1 hour",
) -> DataFrame:
    """(keys, made...) of what a machine's steps return; the first of ``order`` is the time of a row."""
    time = order[0]
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).withColumn("_ms", F.unix_millis(time))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *[c.split()[0] for c in made.split(", ")]]

    def frame(key: tuple, found: list[Row]):
        import pandas as pd

        return pd.DataFrame([dict(zip(keys, key, strict=True)) | r for r in found], columns=names)

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            yield frame(key, expire(held))
            return
        found: list[Row] = []
        rows = pd.concat(list(frames)).sort_values(order)
        for row in rows.to_dict("records"):
            found += step(held, row)
        state.update((json.dumps(held),))
        seen = max(int(rows["_ms"].max()), held.get("seen", 0), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(seen + ttl_s * 1000)
        yield frame(key, found)

    return rows.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, {made}", "held string", "append", GroupStateTimeout.EventTimeTimeout)


# incidents

TOLD = ("severity", "confidence", "title", "summary")
INCIDENT = "fingerprint string, scan_id long, transition string, severity string, occurrences long"


def plain(value: object) -> str:
    return "" if value is None or value == "" else str(value)


def scan(state: dict, row: Row) -> list[Row]:
    """One scan of an evaluation key: its findings are opened, updated or seen again, and what it finds no more is resolved."""
    active = state.setdefault("active", {})
    findings = row["findings"] if row["findings"] is not None else []
    present = {f["fingerprint"]: {c: plain(f[c]) for c in TOLD} for f in findings}
    out: list[Row] = []
    tell = lambda name, what, of: out.append(
        {"fingerprint": name, "scan_id": row["scan_id"], "transition": what, "severity": of["severity"] or None, "occurrences": of["n"]}
    )
    for name in sorted(present):
        told, before = present[name], active.get(name)
        active[name] = told | {"n": before["n"] + 1 if before else 1}
        if before is None:
            tell(name, "opened", active[name])
        elif any(before[c] != told[c] for c in TOLD):
            tell(name, "updated", active[name])
    for name in sorted(set(active) - set(present)):
        tell(name, "resolved", active.pop(name))
    return out


def expired(state: dict) -> list[Row]:
    """What ends when nobody evaluates a key any more."""
    return [
        {"fingerprint": name, "scan_id": None, "transition": "expired", "severity": of["severity"] or None, "occurrences": of["n"]}
        for name, of in sorted(state.get("active", {}).items())
    ]


def incidents(scans: DataFrame, keys: list[str], ttl_s: int = 30 * 86_400, late: str = "1 hour") -> DataFrame:
    """Transitions of incidents over a stream of scans, (keys, scan_at, scan_id, findings); keys end with the evaluation key.

    findings is an array of (fingerprint, severity, confidence, title, summary); a scan without findings resolves what is active.
    Of findings with one fingerprint in a scan the last counts.  What a scan does not evaluate has no row and stays as it is.
    """
    return folded(scans, keys, ["scan_at", "scan_id"], scan, INCIDENT, expired, ttl_s, late)


# life cycle

#: What happens to a device.
DISCOVERED, MOVED, MISSING, CONNECTING, SUCCESS, FAILURE = "discovered", "moved", "missing", "connecting", "success", "failure"
LIFE = "event_id long, state string, failures long, reconnects long, moves long, offline_since_ms long, retry_s double"


def life_step(threshold: int, first_wait: float, longest_wait: float) -> Step:
    def step(state: dict, row: Row) -> list[Row]:
        if not state:
            state |= {"state": DISCOVERED, "failures": 0, "reconnects": 0, "moves": 0, "offline_since_ms": None, "retry_s": 0.0}
        was, kind, at = state["state"], row["kind"], int(row["_ms"])
        since = state["offline_since_ms"]
        if kind in (DISCOVERED, MOVED):
            state["moves"] += kind == MOVED
            state["state"] = "connecting" if was in ("offline", "rediscovering") else was if was == "online" else DISCOVERED
            state["retry_s"] = 0.0
        elif kind == MISSING:
            state["state"] = was if was == "offline" else "rediscovering"
            state["offline_since_ms"] = at if since is None else since
        elif kind == CONNECTING:
            state["state"] = was if was == "online" else "connecting"
        elif kind == SUCCESS:
            state["reconnects"] += was in ("offline", "rediscovering", "degraded") or state["failures"] > 0
            state |= {"state": "online", "failures": 0, "offline_since_ms": None, "retry_s": 0.0}
        elif kind == FAILURE:
            state["failures"] += 1
            state["state"] = "offline" if state["failures"] >= threshold else "degraded"
            if state["state"] == "offline" and since is None:
                state["offline_since_ms"] = at
            state["retry_s"] = float(min(longest_wait, first_wait * 2.0 ** min(state["failures"] - 1, 60)))
        return [{"event_id": row["event_id"]} | state]

    return step


def forgotten(state: dict) -> list[Row]:
    return [{"event_id": None} | state | {"state": "forgotten"}]


def lifecycle(
    events: DataFrame, keys: list[str], threshold: int = 3, first_wait: float = 1.0, longest_wait: float = 60.0, ttl_s: int = 30 * 86_400, late: str = "1 hour"
) -> DataFrame:
    """State of each device after each of its events, (keys, observed_at, event_id, kind): discovered, connecting, online, degraded, offline, rediscovering.

    Failures in a row degrade a device and, from the threshold on, take it offline, with waits that double up to the longest.  A
    device that is missing is rediscovering until it is discovered; a device that nothing is heard of for the time to live is forgotten.
    """
    return folded(events, keys, ["observed_at", "event_id"], life_step(threshold, first_wait, longest_wait), LIFE, forgotten, ttl_s, late)
