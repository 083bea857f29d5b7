"""Buckets without points: fill(none), fill(null), fill(linear)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.ordered import carry_last, micros
from hearthline.session import spread

# Buckets per slice when looking for the bucket before a gap.
_SLICE_BUCKETS = 50_000


# Buckets made from one row at a time.
_CHUNK_BUCKETS = 1_440


def _seconds(seconds: int) -> Column:
    return F.make_dt_interval(secs=F.lit(seconds))


def _steps(start: Column, stop: Column, step_s: int) -> Column:
    """The times from ``start`` up to ``stop``, both included; an empty list if there is none."""
    return F.when(start <= stop, F.sequence(start, stop, _seconds(step_s))).otherwise(
        F.array().cast("array<timestamp_ntz>")
    )


def _buckets_between(gaps: DataFrame, series: Sequence[str], start: Column, stop: Column, width_s: int) -> DataFrame:
    """A row per bucket start in [start, stop], in ``time``. A long gap is cut in chunks that many tasks fill."""
    chunk_s = _CHUNK_BUCKETS * width_s
    chunks = gaps.withColumn("_stop", stop).select("*", F.explode(_steps(start, stop, chunk_s)).alias("_chunk"))
    chunks = spread(chunks, *series, "_chunk")
    chunk_end = F.least(F.col("_stop"), F.col("_chunk") + _seconds(chunk_s - width_s))
    return chunks.select("*", F.explode(_steps(F.col("_chunk"), chunk_end, width_s)).alias("time"))


def fill_gaps(
    edges: DataFrame, series: Sequence[str], width_s: int, t0: Column, t1: Column, linear: bool
) -> DataFrame:
    """The empty buckets of each series between ``t0`` and ``t1`` (both bucket starts, included).

    ``edges`` has one row per non-empty bucket: the series, ``time``, and ``first_value`` / ``last_value``, the values
    next to the gap before and after the bucket. Rows come from the bucket after each gap, so that nothing is joined
    to a spine. ``linear`` interpolates between neighbours; the ends of the range stay NULL.
    """
    series = list(series)
    time = F.col("time")
    step = _seconds(width_s)
    linked = carry_last(
        edges,
        series,
        micros(time),
        F.lit(0),
        {"_before": time, "_value": F.col("last_value")},
        strict=True,
        width=_SLICE_BUCKETS * width_s * 1_000_000,
    )
    gaps = linked.select(
        *series,
        "_before",
        "_value",
        F.col("time").alias("_after"),
        F.col("first_value").alias("_next"),
    )
    start = F.coalesce(F.col("_before") + step, t0)
    empty = _buckets_between(gaps, series, start, F.col("_after") - step, width_s)
    fraction = (micros(time) - micros(F.col("_before"))) / (micros(F.col("_after")) - micros(F.col("_before")))
    value = F.col("_value") + (F.col("_next") - F.col("_value")) * fraction if linear else F.lit(None).cast("double")
    inner = empty.select(*series, "time", value.alias("value"))
    newest = edges.groupBy(*series).agg(F.max("time").alias("_last"))
    tail = _buckets_between(newest, series, F.col("_last") + step, t1, width_s)
    return inner.unionByName(tail.select(*series, "time", F.lit(None).cast("double").alias("value")))


def fill(
    buckets: DataFrame, series: Sequence[str], width_s: int, t0: Column, t1: Column, how: str = "none", several: bool = False
) -> DataFrame:
    """Add the empty buckets of [t0, t1] to bucketed rows (series, time, value), one or more per bucket.

    Where a bucket has ``several`` values, as after ``distinct``, a gap is interpolated from the largest value before
    it to the smallest after it, the order in which they are listed.
    """
    if how == "none":
        return buckets
    if several:
        edges = buckets.groupBy(*series, "time").agg(
            F.min("value").alias("first_value"), F.max("value").alias("last_value")
        )
    else:
        edges = buckets.select(
            *series, "time", F.col("value").alias("first_value"), F.col("value").alias("last_value")
        )
    missing = fill_gaps(edges, series, width_s, t0, t1, linear=how == "linear")
    return buckets.select(*series, "time", "value").unionByName(missing)
