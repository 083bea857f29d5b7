"""The stored points: Parquet by tier and day, kept by rewriting only the days that change."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hearthline.operators.tiers import delete_range, instant, last_write, upsert

PARTITION = ("tier", "day")


def _with_day(points: DataFrame) -> DataFrame:
    return points.withColumn("day", F.to_date("time"))


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_points(
    spark: SparkSession,
    root: str,
    tiers: Sequence[str] | None = None,
    t0: datetime | None = None,
    t1: datetime | None = None,
) -> DataFrame:
    """Stored points; tiers and days outside the range are not read."""
    points = spark.read.parquet(root)
    if tiers is not None:
        points = points.where(F.col("tier").isin(list(tiers)))
    if t0 is not None:
        points = points.where((F.col("day") >= F.lit(t0.date())) & (F.col("time") >= instant(t0)))
    if t1 is not None:
        points = points.where((F.col("day") <= F.lit(t1.date())) & (F.col("time") <= instant(t1)))
    return points.drop("day")


def _replace_days(points: DataFrame, root: str) -> None:
    """Write whole days in place of the stored ones.

    Ranges over the sort order spread a heavy day over several tasks and give files that skip by series.
    """
    order = [*PARTITION, "measurement", "field", "time"]
    (
        _with_day(points)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy(*PARTITION)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(root)
    )


def write_points(points: DataFrame, root: str) -> None:
    """``SELECT .. INTO``: store points, the last write of a key wins; other days are left alone."""
    spark = points.sparkSession
    if not _exists(spark, root):
        _replace_days(last_write(points), root)
        return
    _replace_days(upsert(touched_days(points, root).drop("day"), points), root)


def append_points(points: DataFrame, root: str) -> None:
    """Add writes to the store without reading or rewriting anything: a late point costs its own row.

    A key may be stored several times then; ``read_newest`` gives the write in force, and ``compact_days`` brings a day back
    to one row per key. Appending the same writes twice changes nothing, so a job that is repeated does no harm.
    """
    order = [*PARTITION, "measurement", "field", "time"]
    # ranges, so that a day is in few files, and a heavy one in several tasks
    _with_day(points).repartitionByRange(*order).write.partitionBy(*PARTITION).mode("append").parquet(root)


def read_newest(
    spark: SparkSession,
    root: str,
    tiers: Sequence[str] | None = None,
    t0: datetime | None = None,
    t1: datetime | None = None,
) -> DataFrame:
    """``read_points`` of a store that was appended to: the last write of each key."""
    return last_write(read_points(spark, root, tiers, t0, t1))


def compact_days(spark: SparkSession, root: str, least_files: int = 2) -> int:
    """Rewrite the days that are in ``least_files`` files or more as one row per key; the number of days rewritten.

    Only the names of files are looked at to choose the days; the others are not read. The commit replaces whole days; it may
    be repeated after a failure, as old and new files hold the same newest writes. No writer may append to a day meanwhile.
    """
    # one row per tier and day
    files = spark.read.parquet(root).select(*PARTITION, F.col("_metadata.file_path").alias("file")).distinct()
    days = files.groupBy(*PARTITION).count().where(F.col("count") >= least_files).collect()
    if days:
        stored = spark.read.parquet(root)
        _replace_days(last_write(stored.where(_folders(days)).drop("day")), root)
    return len(days)


def touched_days(points: DataFrame, root: str) -> DataFrame:
    """The stored points of the tiers and days that ``points`` falls in; no other folder is listed for reading."""
    # one row per folder that is written
    days = _with_day(points).select(*PARTITION).distinct().collect()
    return points.sparkSession.read.parquet(root).where(_folders(days)).select(*points.columns, "day")


def _folders(days: list[Row]) -> Column:
    """A filter of literal tiers and days, which prunes folders before the scan."""
    by_tier: dict[str | None, list[date | None]] = {}
    for row in days:
        by_tier.setdefault(row["tier"], []).append(row["day"])
    parts = []
    for tier, listed in by_tier.items():
        known = F.col("day").isin([d for d in listed if d is not None])
        found = known | F.col("day").isNull() if None in listed else known
        parts.append((F.col("tier").isNull() if tier is None else F.col("tier") == tier) & found)
    return reduce(or_, parts, F.lit(False))


def delete_points(spark: SparkSession, root: str, measurement: str, t0: datetime, t1: datetime) -> None:
    """Delete a measurement between two instants, both inclusive, in every tier."""
    stored = spark.read.parquet(root)
    days = stored.where(F.col("day").between(F.lit(t0.date()), F.lit(t1.date())))
    _drop_emptied(spark, root, days, delete_range(days, measurement, t0, t1))


def expire_points(spark: SparkSession, root: str, tiers: DataFrame, as_of: datetime) -> None:
    """Enforce retention: days wholly past their tier's duration go as folders, unread; only the border day is rewritten."""
    horizons: dict[str, datetime] = {}
    # one row per tier
    for row in tiers.where("duration_hours IS NOT NULL").select("tier", "duration_hours").collect():
        try:
            horizons[row["tier"]] = as_of - timedelta(hours=int(row["duration_hours"]))
        except OverflowError:  # longer than there are dates: kept
            continue
    border = border_days(spark, root, horizons)
    kept = [(F.col("tier") == tier) & (F.col("time") >= instant(horizon)) for tier, horizon in horizons.items()]
    _drop_emptied(spark, root, border, border.where(reduce(or_, kept, F.lit(False))))
    for tier, horizon in horizons.items():
        for day in _stored_days(spark, root, tier):
            if day < horizon.date():
                _remove(spark, f"{root}/tier={tier}/day={day}")


def border_days(spark: SparkSession, root: str, horizons: dict[str, datetime]) -> DataFrame:
    """The stored points of the day on which each tier's horizon lies."""
    return spark.read.parquet(root).where(_folders([Row(tier=t, day=h.date()) for t, h in horizons.items()]))


def _stored_days(spark: SparkSession, root: str, tier: str) -> list[date]:
    """Days of a tier, by the names of its folders."""
    folder = f"{root}/tier={tier}"
    if not _exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    # points without a time are in a folder that is no day
    return [date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and n[4:5].isdigit()]


def _drop_emptied(spark: SparkSession, root: str, before: DataFrame, after: DataFrame) -> None:
    """Rewrite the days ``after`` still has, and remove the folders of those it emptied."""
    emptied = before.select(*PARTITION).distinct().join(
        after.select(*PARTITION).distinct(), list(PARTITION), "left_anti"
    )
    # one row per stored day and tier, the list a file system keeps as folders
    folders = [(row["tier"], row["day"]) for row in emptied.collect()]
    _replace_days(after.drop("day"), root)
    for tier, day in folders:
        _remove(spark, f"{root}/tier={tier}/day={day}")


def drop_tier(spark: SparkSession, root: str, tier: str) -> None:
    _remove(spark, f"{root}/tier={tier}")


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
