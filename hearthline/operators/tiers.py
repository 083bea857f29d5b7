"""Selection, copying, upsert and retention of points by tier."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT_KEY = ("tier", "measurement", "time", "field")


def instant(time) -> Column:
    """A datetime as a literal of the points' own type, so that comparisons reach the Parquet scan."""
    return time if isinstance(time, Column) else F.lit(time).cast("timestamp_ntz")


def scan_points(points: DataFrame, tier: str, measurement: str, fields: Sequence[str] | None = None) -> DataFrame:
    """One measurement of one tier."""
    found = points.where((F.col("tier") == tier) & (F.col("measurement") == measurement))
    return found.where(F.col("field").isin(list(fields))) if fields else found


def scan_tiers(points: DataFrame, tiers: Sequence[str], measurement: str | None = None) -> DataFrame:
    """The bag union of several tiers, read in one scan."""
    found = points.where(F.col("tier").isin(list(tiers)))
    return found.where(F.col("measurement") == measurement) if measurement else found


def time_range(points: DataFrame, t0, t1) -> DataFrame:
    """Both ends inclusive."""
    return points.where((F.col("time") >= instant(t0)) & (F.col("time") <= instant(t1)))


def time_relative(points: DataFrame, as_of: Column, back: str, upto: str | None = None) -> DataFrame:
    """``time > now() - back [AND time < now() - upto]`` with ``as_of`` for now; spans are written ``20 minutes``."""
    found = points.where(F.col("time") > as_of - F.expr(f"INTERVAL {back}"))
    return found if upto is None else found.where(F.col("time") < as_of - F.expr(f"INTERVAL {upto}"))


def millis(epoch_ms: int) -> Column:
    """An instant given in epoch milliseconds."""
    return F.timestamp_millis(F.lit(epoch_ms)).cast("timestamp_ntz")


def last_write(points: DataFrame, key: Sequence[str] = POINT_KEY) -> DataFrame:
    """Keep the newest write of each key; copies of a key are combined before the shuffle."""
    return points.groupBy(*key).agg(
        F.max_by("value", "write_seq").alias("value"), F.max("write_seq").alias("write_seq")
    )


def upsert(points: DataFrame, written: DataFrame) -> DataFrame:
    """Points after ``written`` was stored on top of them."""
    return last_write(points.unionByName(written))


def into(points: DataFrame, tier: str, measurement: str | None = None, field: str | None = None) -> DataFrame:
    """Re-address points, as the INTO and AS clauses do."""
    moved = points.withColumn("tier", F.lit(tier))
    if measurement is not None:
        moved = moved.withColumn("measurement", F.lit(measurement))
    return moved if field is None else moved.withColumn("field", F.lit(field))


def backfill(points: DataFrame, src: str, dst: str, field: str, t0, t1, measurement: str | None = None) -> DataFrame:
    """Raw copy of one field over a time range, ends inclusive."""
    found = time_range(scan_tiers(points, [src], measurement), t0, t1)
    return into(found.where(F.col("field") == field), dst)


def backfill_chunks(points: DataFrame, src: str, dst: str, origin: datetime, weeks: int = 10) -> DataFrame:
    """The copy cut in slices of some weeks from ``origin``; one scan, the slice number is a column to write by."""
    days = F.datediff(F.col("time"), F.lit(origin.date()))
    return into(scan_tiers(points, [src]), dst).withColumn("chunk", F.floor(days / (7 * weeks)).cast("bigint"))


def delete_range(points: DataFrame, measurement: str, t0, t1) -> DataFrame:
    """Points left after deleting a measurement between two instants, both inclusive."""
    gone = (F.col("measurement") == measurement) & F.col("time").between(instant(t0), instant(t1))
    # a point without a measurement or a time is not in the range
    return points.where(~F.coalesce(gone, F.lit(False)))


def expire(points: DataFrame, tiers: DataFrame, as_of: Column) -> DataFrame:
    """Drop points older than their tier's duration; no duration, or an unknown tier, keeps them."""
    kept = F.col("duration_hours").isNull() | (
        F.col("time") >= as_of - F.make_dt_interval(hours=F.col("duration_hours").try_cast("int"))
    )
    return points.join(tiers.select("tier", "duration_hours"), "tier", "left").where(kept).select(*points.columns)


def drop_tier(points: DataFrame, tier: str) -> DataFrame:
    return points.where(F.col("tier").isNull() | (F.col("tier") != tier))


def duration_hours(text: Column) -> Column:
    """``8w``, ``10d``, ``2h``, ``1344h0m0s`` as whole hours; ``INF`` and zero are NULL (kept for ever)."""
    number = F.regexp_extract(text, r"^(\d+)", 1).try_cast("bigint")
    factor = (
        F.when(text.rlike(r"^\d+w"), 168).when(text.rlike(r"^\d+d"), 24).when(text.rlike(r"^\d+h"), 1)
    )
    hours = F.try_multiply(number, factor.cast("bigint"))
    return F.when(hours > 0, hours)


def current_tiers(log: DataFrame) -> DataFrame:
    """State of the tiers after a log (tier, duration text, seq) of create and alter: the later row wins."""
    changes = log.withColumn("hours", duration_hours(F.col("duration")))
    return changes.groupBy("tier").agg(F.max_by("hours", "seq").alias("duration_hours"), F.max("seq").alias("seq"))


def current_specs(created: DataFrame, dropped: DataFrame) -> DataFrame:
    """Definitions that remain: the newest of each name, without the names dropped since."""
    newest = created.groupBy("name").agg(
        F.max("seq").alias("seq"),
        *[F.max_by(c, "seq").alias(c) for c in created.columns if c not in ("name", "seq")],
    )
    drops = dropped.groupBy("name").agg(F.max("seq").alias("dropped_seq"))
    later = (newest["name"] == drops["name"]) & (drops["dropped_seq"] > newest["seq"])
    return newest.join(drops, later, "left_anti")
