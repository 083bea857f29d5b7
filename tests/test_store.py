"""The stored points: upsert, deletion, retention, whole tiers."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline.operators.definitions import levels, run_definitions, with_schedule
from hearthline.operators.rollup import rollup_by_specs
from hearthline.sources import dims
from hearthline.sources import points_store as store

T0 = datetime(2024, 1, 1)
SCHEMA = "tier string, measurement string, time timestamp_ntz, field string, value double, write_seq bigint"


@pytest.fixture
def root(spark, tmp_path):
    rows = [
        (tier, m, T0 + timedelta(hours=6 * i), "fTempA", float(i), i)
        for tier in ("autogen", "two_month")
        for m in ("sSens1", "sSens2")
        for i in range(40)
    ]
    path = str(tmp_path / "points")
    store.write_points(spark.createDataFrame(rows, SCHEMA), path)
    return path


def rows_of(spark, root):
    return store.read_points(spark, root)


def test_first_write(spark, root):
    assert rows_of(spark, root).count() == 160
    assert os.path.isdir(f"{root}/tier=autogen/day=2024-01-01")


def test_upsert_rewrites_only_touched_days(spark, root):
    before = {d: os.listdir(f"{root}/tier=autogen/{d}") for d in os.listdir(f"{root}/tier=autogen")}
    new = [
        ("autogen", "sSens1", T0, "fTempA", 99.0, 1000),
        ("autogen", "sSens1", T0 + timedelta(hours=6), "fTempA", -5.0, -1),
        ("autogen", "sSens9", T0 + timedelta(hours=1), "fHumi", 1.0, 1001),
    ]
    store.write_points(spark.createDataFrame(new, SCHEMA), root)
    stored = rows_of(spark, root)
    assert stored.count() == 161
    values = {r["time"]: r["value"] for r in stored.where("tier = 'autogen' AND measurement = 'sSens1'").collect()}
    # the older write of six o'clock does not replace the newer
    assert values[T0] == 99.0 and values[T0 + timedelta(hours=6)] == 1.0
    after = {d: os.listdir(f"{root}/tier=autogen/{d}") for d in os.listdir(f"{root}/tier=autogen")}
    changed = [d for d in before if before[d] != after[d]]
    assert changed == ["day=2024-01-01"]


def test_delete(spark, root):
    store.delete_points(spark, root, "sSens2", T0, T0 + timedelta(hours=30))
    left = rows_of(spark, root)
    assert left.count() == 160 - 2 * 6
    assert left.where("measurement = 'sSens1'").count() == 80


def test_delete_of_whole_days(spark, root):
    store.delete_points(spark, root, "sSens1", T0, T0 + timedelta(days=100))
    store.delete_points(spark, root, "sSens2", T0, T0 + timedelta(days=2) - timedelta(microseconds=1))
    assert rows_of(spark, root).count() == 2 * 32
    assert "day=2024-01-01" not in os.listdir(f"{root}/tier=autogen")


def test_expire(spark, root):
    as_of = T0 + timedelta(hours=1344 + 49)
    store.expire_points(spark, root, dims.tiers(spark), as_of)
    left = rows_of(spark, root)
    assert left.where("tier = 'autogen'").count() == 80
    kept = left.where("tier = 'two_month'")
    assert kept.count() == 2 * (40 - 9)
    assert sorted(os.listdir(f"{root}/tier=two_month"))[0] == "day=2024-01-03"


def test_drop_tier(spark, root):
    store.drop_tier(spark, root, "autogen")
    assert [r["tier"] for r in rows_of(spark, root).select("tier").distinct().collect()] == ["two_month"]


def test_read_prunes_partitions(spark, root):
    found = store.read_points(spark, root, ["autogen"], T0 + timedelta(days=3), T0 + timedelta(days=4))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "tier#" in plan.split("PartitionFilters")[1]
    assert found.count() == 2 * 5


def partition_filters(df):
    return df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_upsert_and_expiry_read_only_touched_folders(spark, root):
    new = spark.createDataFrame([("autogen", "sSens1", T0 + timedelta(days=1), "fTempA", 9.0, 99)], SCHEMA)
    touched = store.touched_days(new, root)
    assert all(x in partition_filters(touched) for x in ("tier#", "autogen", "day#", "2024-01-02"))
    assert touched.count() == 8
    border = store.border_days(spark, root, {"two_month": T0 + timedelta(days=3, hours=1)})
    assert all(x in partition_filters(border) for x in ("tier#", "two_month", "day#", "2024-01-04"))
    assert border.count() == 8


def test_points_without_a_tier_are_upserted(spark, tmp_path):
    path = str(tmp_path / "nameless")
    for value in (1.0, 2.0):
        store.write_points(spark.createDataFrame([(None, "m", T0, "f", value, int(value))], SCHEMA), path)
    assert [r["value"] for r in store.read_points(spark, path).collect()] == [2.0]


def test_appended_writes(spark, root):
    """A late point adds its own file; the newest write is read, and compaction leaves one row per key."""
    files = lambda d: sorted(f for f in os.listdir(f"{root}/tier=autogen/day={d}") if f.endswith(".parquet"))
    before = files("2024-01-01"), files("2024-01-02")
    late = [("autogen", "sSens1", T0, "fTempA", 99.0, 1000), ("autogen", "sSens1", T0, "fTempA", 50.0, 999)]
    store.append_points(spark.createDataFrame(late, SCHEMA), root)
    assert set(before[0]) < set(files("2024-01-01")) and files("2024-01-02") == before[1]
    assert store.read_points(spark, root).count() == 162
    newest = store.read_newest(spark, root, ["autogen"], T0, T0)
    assert {(r["measurement"], r["value"]) for r in newest.collect()} == {("sSens1", 99.0), ("sSens2", 0.0)}
    untouched = files("2024-01-02")
    assert store.compact_days(spark, root) >= 1
    assert store.read_points(spark, root).count() == 160 and len(untouched) == len(files("2024-01-02"))
    again = store.read_newest(spark, root, ["autogen"], T0, T0)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, newest.collect()))


# ---- definitions that run into the store


def definitions(spark, *rows):
    return dims.scheduled_specs(spark, list(rows))


def test_levels_follow_the_stored_tiers(spark):
    five = ("five", "mean", "f", "f", "raw", "mid", "m", 300)
    hour = ("an_hour", "mean", "f", "f", "mid", "top", "m", 3600)
    other = ("other", "max", "g", "g", "raw", "top", "m", 3600)
    own = ("own", "mean", "f", "f", "top", "top", "m", 86400)
    rows = with_schedule(definitions(spark, hour, five, other, own)).collect()
    assert [[s["name"] for s in level] for level in levels(rows)] == [["five", "other"], ["an_hour"], ["own"]]
    assert [(s["every_s"], s["for_s"]) for s in rows] == [(3600, 3600), (300, 300), (3600, 3600), (86400, 86400)]
    assert levels([]) == []
    back = ("back", "mean", "f", "f", "mid", "raw", "m", 60)
    with pytest.raises(ValueError, match="feed each other"):
        levels(definitions(spark, five, back).collect())
    with pytest.raises(ValueError, match="one name"):
        levels(definitions(spark, five, five).collect())


def test_definitions_run_into_the_store(spark, tmp_path):
    root = str(tmp_path / "points")
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    raw = [("raw", "m", at(k), "f", float(k), k) for k in range(0, 180, 10)]
    specs = definitions(
        spark,
        ("half", "mean", "f", "f", "raw", "mid", "m", 1800, None, 7200),
        ("hour", "max", "f", "f", "mid", "top", "m", 3600),
        ("day", "mean", "f", "d", "mid", "top", "m", 86400),
        ("twice", "min", "f", "f", "mid", "top", "m", 3600),
    )
    store.append_points(spark.createDataFrame(raw, SCHEMA), root)
    assert run_definitions(spark, root, specs, write_seq=1000) == 4

    def tier(name, field):
        rows = store.read_newest(spark, root, [name]).where(F.col("field") == field).collect()
        return {int((r["time"] - T0).total_seconds() // 60): r["value"] for r in rows}

    assert tier("mid", "f") == {0: 10.0, 30: 40.0, 60: 70.0, 90: 100.0, 120: 130.0, 150: 160.0}
    # of two definitions with one target the later by name is in force
    assert tier("top", "f") == {0: 10.0, 60: 70.0, 120: 130.0} and tier("top", "d") == {0: 85.0}
    # late points: the run at three o'clock looks back two hours, the day's definition is not due
    late = [("raw", "m", at(m), "f", 1000.0, 500 + m) for m in (5, 65, 125)]
    store.append_points(spark.createDataFrame(late, SCHEMA), root)
    assert run_definitions(spark, root, specs, now=at(180), write_seq=2000) == 3
    assert tier("mid", "f") == {0: 10.0, 30: 40.0, 60: 302.5, 90: 100.0, 120: 347.5, 150: 160.0}
    assert tier("top", "f") == {0: 10.0, 60: 70.0, 120: 160.0} and tier("top", "d") == {0: 85.0}
    assert run_definitions(spark, root, specs, now=at(181)) == 0
    with pytest.raises(ValueError, match="no such aggregate"):
        run_definitions(spark, root, definitions(spark, ("x", "median", "f", "f", "raw", "mid", "m", 60)))


def test_unknown_aggregates_are_no_nulls(spark):
    points = spark.createDataFrame([("raw", "m", T0, "f", 1.0, 1)], SCHEMA)
    specs = definitions(spark, ("x", "median", "f", "f", "raw", "mid", "m", 60))
    with pytest.raises(Exception, match="no such aggregate"):
        rollup_by_specs(points, specs).collect()
