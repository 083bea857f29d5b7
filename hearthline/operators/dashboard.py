"""The dashboard query: one aggregate per bucket over several tiers, gaps filled, listed by time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.fill import fill
from hearthline.operators.ordered import micros
from hearthline.operators.rollup import rollup, rollup_distinct
from hearthline.operators.tiers import instant, scan_tiers

SERIES = ("measurement", "field")


def whole_days(points: DataFrame) -> tuple[Column, Column]:
    """The days around all points, from the first midnight to the one after the last point; no job runs for it here."""
    ends = points.agg(F.struct(F.min("time").alias("first"), F.max("time").alias("last"))).scalar()
    day = lambda time: F.date_trunc("day", time).cast("timestamp_ntz")
    return day(ends["first"]), day(ends["last"]) + F.make_dt_interval(days=F.lit(1))


def _bucket_of(time: datetime | Column, interval_s: int) -> Column:
    if isinstance(time, datetime):
        return instant(time - (time - datetime(1970, 1, 1)) % timedelta(seconds=interval_s))
    at = micros(time)
    return F.timestamp_micros(at - F.pmod(at, F.lit(interval_s * 1_000_000))).cast("timestamp_ntz")


def dashboard(
    points: DataFrame,
    agg: str,
    tiers: Sequence[str],
    t0: datetime | Column,
    t1: datetime | Column,
    interval_s: int,
    how: str = "none",
    measurement: str | None = None,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """``SELECT agg(field) FROM <tiers> WHERE $timeFilter GROUP BY time($__interval) fill(how)``.

    ``t0`` is included, ``t1`` excluded, each an instant or a column without rows of its own; the range may cut its first and last bucket, which then hold the points inside
    it. The points of all tiers count together. Only the result is sorted.
    """
    found = scan_tiers(points, tiers, measurement)
    found = found.where((F.col("time") >= instant(t0)) & (F.col("time") < instant(t1)))
    if fields is not None:
        found = found.where(F.col("field").isin(list(fields)))
    if agg == "distinct":
        buckets = rollup_distinct(found, interval_s, SERIES)
    else:
        buckets = rollup(found, agg, interval_s, SERIES)
    before_end = t1 - (timedelta(microseconds=1) if isinstance(t1, datetime) else F.expr("INTERVAL '0.000001' SECOND"))
    first, last = _bucket_of(t0, interval_s), _bucket_of(before_end, interval_s)
    filled = fill(buckets, SERIES, interval_s, first, last, how, several=agg == "distinct")
    return filled.orderBy("time")
