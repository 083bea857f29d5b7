"""Sliced last-known-value operations against plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.operators.ordered import HOUR_US, carry_last, micros, slice_start

US = 1_000_000


@pytest.fixture(scope="module")
def rows(spark):
    """One key with two thirds of the rows, a hot day, a hot second, and one instant with many rows."""
    rng = random.Random(7)
    data, seq = [], 0

    def add(key, position):
        nonlocal seq
        value = rng.choice([None, None, None, seq])
        data.append((key, position, seq, value, rng.choice([None, float(seq)])))
        seq += 1

    for _ in range(300):
        add(rng.choice(["a", "b", None]), rng.randrange(0, 40 * 86400) * US)
    for _ in range(300):
        add("a", 5 * 86400 * US + rng.randrange(0, 86400 * US))
    for _ in range(200):
        add("a", 9 * 86400 * US + 77 * US + rng.randrange(0, US))
    for _ in range(200):
        add("a", 9 * 86400 * US + 77 * US + 5)
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, position bigint, seq bigint, value bigint, other double").cache()


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [1, 7 * US, 300 * US, HOUR_US, 24 * HOUR_US, 10_000 * HOUR_US])
def test_carry_last_equals_window(rows, strict, width):
    carried = carry_last(
        rows,
        ["key"],
        F.col("position"),
        F.col("seq"),
        {"v": F.col("value"), "o": F.col("other")},
        strict=strict,
        width=width,
    )
    frame = W.partitionBy("key").orderBy("position", "seq")
    frame = frame.rowsBetween(W.unboundedPreceding, -1 if strict else W.currentRow)
    plain = rows.withColumn("v", F.last("value", True).over(frame)).withColumn("o", F.last("other", True).over(frame))
    assert sorted(map(str, carried.collect())) == sorted(map(str, plain.collect()))


def test_slices_are_runs_of_bounded_length(rows):
    """The key that holds two thirds of the rows is cut as any other: no slice is longer than its width."""
    sliced = rows.withColumn("_slice", slice_start(F.col("position"), HOUR_US))
    runs = sliced.groupBy("key", "_slice").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    listed = sorted(runs.collect(), key=lambda r: (r["key"] or "", r["_slice"]))
    assert all(r["_slice"] <= r["first"] and r["last"] < r["_slice"] + HOUR_US for r in listed)
    assert sum(r["key"] == "a" for r in listed) > 100
    for before, after in zip(listed, listed[1:]):
        if before["key"] == after["key"]:
            assert before["last"] < after["first"]


def test_building_starts_no_job(spark, rows):
    rows.count()
    spark.sparkContext.setJobGroup("building", "carry_last")
    carry_last(rows, ["key"], F.col("position"), F.col("seq"), {"v": F.col("value")})
    started = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("tests", "")
    assert list(started) == []


@pytest.mark.parametrize("width", [1, US, HOUR_US])
def test_rising_values(rows, width):
    value = {"p": F.col("position")}
    got = carry_last(
        rows, ["key"], F.col("position"), F.col("seq"), value, strict=True, rising=True, width=width
    )
    plain = rows.withColumn("p", F.lag("position").over(W.partitionBy("key").orderBy("position", "seq")))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_micros_of_times_before_the_epoch(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.5' AS t").select(micros(F.col("t")).alias("u")).first()
    assert row["u"] == -500_000
