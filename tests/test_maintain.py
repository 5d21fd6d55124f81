"""Storage upkeep: whole rebuilds, nothing to do, late rows, interruption, pruning."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlore.operators import history
from gridlore.sources import archive, maintain

TIERS = {"warm": (1, 10), "cool": (3, 60)}
TODAY = date(2024, 1, 9)


def readings(spark, seed, n, first=1, last=8):
    random.seed(seed)
    start = datetime(2024, 1, first)
    span = (last - first + 1) * 86_400
    rows = [
        (seed * 100_000 + k, k % 3, start + timedelta(seconds=random.randrange(span)), f"r{k % 2}", random.random() if k % 5 else None, random.choice("ab") if k % 3 else None)
        for k in range(n)
    ]
    return spark.createDataFrame(rows, maintain.ROW)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(a) == rows(b)


def whole(spark, root, rows, upto):
    cut = F.lit(upto).cast("timestamp_ntz")
    same(maintain.tier_rows(spark, root, "warm"), history.tier(rows, 10, cut))
    same(maintain.joined_runs(spark, root), history.state_runs(rows.where(F.col("observed_at") < cut), maintain.SERIES))
    same(spark.read.schema(f"{maintain.ROW}, day date").parquet(f"{root}/archive").drop("day"), rows.where(F.col("observed_at") < cut))


def test_runs_touch_what_has_changed_and_nothing_else(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = readings(spark, 1, 900)
    maintain.append_raw(first, root)
    made = maintain.maintain(spark, root, TODAY, TIERS).groupBy("artifact").count().collect()
    assert {r.artifact: r["count"] for r in made} == {"warm": 7, "cool": 5, "runs": 7, "archive": 7}
    whole(spark, root, first, date(2024, 1, 8))
    assert maintain.maintain(spark, root, TODAY, TIERS).count() == 0
    left = {r.day for r in spark.read.parquet(f"{root}/raw").select("day").distinct().collect()}
    assert left == {date(2024, 1, d) for d in (6, 7, 8)}  # older days are in all artifacts and gone
    late = readings(spark, 2, 40, 2, 2)
    maintain.append_raw(late, root)
    again = maintain.maintain(spark, root, TODAY, TIERS)
    assert {(r.artifact, r.day) for r in again.collect()} == {(a, date(2024, 1, 2)) for a in ("warm", "cool", "runs", "archive")}
    whole(spark, root, first.union(late), date(2024, 1, 8))
    assert maintain.maintain(spark, root, TODAY, TIERS).count() == 0


def test_an_interrupted_run_is_repeated(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    rows = readings(spark, 3, 300)
    maintain.append_raw(rows, root)
    with monkeypatch.context() as m:
        m.setattr(archive, "manifest", lambda df, real=archive.manifest, calls=[]: calls.append(1) or (real(df) if len(calls) < 2 else 1 / 0))
        with pytest.raises(ZeroDivisionError):
            maintain.maintain(spark, root, TODAY, TIERS)  # stops after the artifacts, before the ledger
    assert maintain.ledger(spark, root).count() == 0 and spark.read.parquet(f"{root}/raw").count() == 300
    assert maintain.maintain(spark, root, TODAY, TIERS).count() == 26
    whole(spark, root, rows, date(2024, 1, 8))


def test_nothing_there(spark, tmp_path):
    assert maintain.maintain(spark, f"file://{tmp_path}/none", TODAY, TIERS).count() == 0
    with pytest.raises(ValueError, match="over"):
        maintain.maintain(spark, f"file://{tmp_path}/none", TODAY, {"warm": (0, 10)})
