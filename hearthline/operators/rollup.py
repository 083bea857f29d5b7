"""Downsampling of long-form points (tier, measurement, time, field, value, write_seq).

All of these are partial + final hash aggregates with one exchange, so a series or bucket that holds a large share of
the rows is combined before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.ordered import micros, order_key

SERIES = ("tier", "measurement", "field")
#: What a rollup definition may compute.
SPEC_AGGREGATES = ("mean", "min", "max", "last")


def bucket(width_s: int, time: str = "time") -> Column:
    """Start of the fixed bucket, aligned to the epoch."""
    return F.window(time, f"{width_s} seconds").start


def write_order() -> Column:
    """Points order by time, and by write sequence where tiers overlap."""
    return order_key(micros(F.col("time")), F.col("write_seq"))


def aggregate(agg: str, value: Column) -> Column:
    if agg == "last":
        return F.max_by(value, write_order())
    return {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[agg](value)


def rollup(points: DataFrame, agg: str, width_s: int, by: Sequence[str] = SERIES) -> DataFrame:
    """``SELECT agg(value) GROUP BY time(width)`` for every series at once, in batch or, with a watermark, in a stream."""
    return (
        points.groupBy(*by, F.window("time", f"{width_s} seconds").alias("_bucket"))
        .agg(aggregate(agg, F.col("value")).alias("value"))
        .select(*by, F.col("_bucket.start").alias("time"), "value")
    )


def rollup_distinct(points: DataFrame, width_s: int, by: Sequence[str] = SERIES) -> DataFrame:
    """The distinct values of each bucket, one row per value."""
    return points.select(*by, bucket(width_s).alias("time"), "value").distinct()


def rollup_star(points: DataFrame, aggs: Sequence[str], width_s: int, by: Sequence[str] = SERIES) -> DataFrame:
    """``min(*)``, ``max(*)``: every field, under the names ``<agg>_<field>``; all aggregates in one pass."""
    grouped = points.groupBy(*by, F.window("time", f"{width_s} seconds").alias("_bucket")).agg(
        *[aggregate(a, F.col("value")).alias(f"_{a}") for a in aggs]
    )
    named = F.array(*[F.struct(F.lit(a).alias("agg"), F.col(f"_{a}").alias("value")) for a in aggs])
    rows = grouped.select(*by, F.col("_bucket.start").alias("time"), F.explode(named).alias("_row"))
    field = F.concat("_row.agg", F.lit("_"), "field")
    return rows.withColumn("field", field).select(*by, "time", F.col("_row.value").alias("value"))


def rollup_wide(
    points: DataFrame, aggs: dict[str, tuple[str, str]], width_s: int, by: Sequence[str] = ("tier", "measurement")
) -> DataFrame:
    """Several aggregates in one statement: ``{output: (agg, field)}``, one column each."""
    columns = [
        aggregate(agg, F.when(F.col("field") == field, F.col("value"))).alias(name)
        for name, (agg, field) in aggs.items()
    ]
    wanted = sorted({field for _, field in aggs.values()})
    return (
        points.where(F.col("field").isin(wanted))
        .groupBy(*by, bucket(width_s).alias("time"))
        .agg(*columns)
        .select(*by, "time", *aggs)
    )


def rollup_by_tags(
    points: DataFrame, agg: str, width_s: int, not_tags: Sequence[str] = ("time", "value", "write_seq")
) -> DataFrame:
    """``GROUP BY time(width), *``: every column that is not a field is a tag."""
    return rollup(points, agg, width_s, [c for c in points.columns if c not in not_tags])


def round2(value: Column) -> Column:
    """Two decimals, still a floating-point number."""
    return F.round(value * F.lit(100.0)) / F.lit(100.0)


def mean_range(points: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Mean over everything selected, without buckets."""
    return points.groupBy(*by).agg(F.avg("value").alias("mean"))


def cascade(points: DataFrame, widths_s: Sequence[int], by: Sequence[str] = SERIES) -> DataFrame:
    """Chain of means through the tiers: each level averages the buckets of the level before, unweighted."""
    level = points
    for width in widths_s:
        level = rollup(level, "mean", width, by)
    return level


def cascade_weighted(points: DataFrame, widths_s: Sequence[int], by: Sequence[str] = SERIES) -> DataFrame:
    """The same chain carrying (sum, n), so that the result is the mean of the raw points."""
    level = points.select(*by, "time", F.col("value").alias("_sum"), F.col("value").isNotNull().cast("bigint").alias("_n"))
    for width in widths_s:
        level = (
            level.groupBy(*by, bucket(width).alias("_bucket"))
            .agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
            .withColumnRenamed("_bucket", "time")
        )
    return level.select(*by, "time", (F.col("_sum") / F.col("_n")).alias("value"), F.col("_n").alias("n"))


def rollup_by_specs(points: DataFrame, specs: DataFrame) -> DataFrame:
    """Run every rollup definition in one scan of the points.

    Bucket width, aggregate, target tier and target field come from the definition row. A definition table is small;
    Spark broadcasts it if its size is below the session's threshold and joins by shuffle otherwise.
    """
    second = F.unix_seconds(F.col("time").cast("timestamp"))
    start = F.timestamp_seconds(second - F.pmod(second, F.col("width_s"))).cast("timestamp_ntz")
    matched = points.join(
        specs.withColumnRenamed("src_tier", "tier").withColumnRenamed("src_field", "field"),
        ["tier", "measurement", "field"],
    )
    grouped = matched.groupBy("name", "agg", "dst_tier", "measurement", "dst_field", start.alias("_start")).agg(
        *[aggregate(a, F.when(F.col("agg") == a, F.col("value"))).alias(a) for a in SPEC_AGGREGATES]
    )
    known = F.coalesce(*[F.when(F.col("agg") == a, F.col(a)) for a in SPEC_AGGREGATES])
    unknown = F.raise_error(F.concat(F.lit("no such aggregate: "), F.coalesce("agg", F.lit("NULL")))).cast("double")
    chosen = F.when(F.col("agg").isin(*SPEC_AGGREGATES), known).otherwise(unknown)
    return grouped.select(
        "name",
        F.col("dst_tier").alias("tier"),
        "measurement",
        F.col("_start").alias("time"),
        F.col("dst_field").alias("field"),
        chosen.alias("value"),
    )


def resample(
    points: DataFrame, agg: str, width_s: int, every_s: int, span_s: int, by: Sequence[str] = SERIES
) -> DataFrame:
    """``RESAMPLE EVERY .. FOR ..``: each run recomputes the buckets that touch the span before it.

    A bucket that the span's start cuts is computed from all its points, so that a run never replaces a good value by
    that of a part. A run sees no point after it. Points are first combined into parts that no bucket and no run cuts, and
    only these are given to each run that sees them.
    """
    first, last = _PARTIAL[agg]
    part_s = math.gcd(width_s, every_s)
    parts = points.groupBy(*by, bucket(part_s).alias("_part")).agg(*first(F.col("value")))
    wider = span_s + -(-width_s // every_s) * every_s
    run = F.window("_part", f"{wider} seconds", f"{every_s} seconds").end
    bucket_end = F.col("_start") + F.make_dt_interval(secs=F.lit(width_s))
    return (
        parts.withColumn("run_at", run)
        .withColumn("_start", bucket(width_s, "_part"))
        .where(bucket_end > F.col("run_at") - F.make_dt_interval(secs=F.lit(span_s)))
        .groupBy(*by, "run_at", F.col("_start").alias("time"))
        .agg(last().alias("value"))
        .select(*by, "run_at", "time", "value")
    )


#: Aggregates in two steps: over the points of a part, and over parts.
_PARTIAL = {
    "mean": (lambda v: [F.sum(v).alias("_a"), F.count(v).alias("_b")], lambda: F.sum("_a") / F.nullif(F.sum("_b"), F.lit(0))),
    "sum": (lambda v: [F.sum(v).alias("_a")], lambda: F.sum("_a")),
    "count": (lambda v: [F.count(v).alias("_a")], lambda: F.sum("_a")),
    "min": (lambda v: [F.min(v).alias("_a")], lambda: F.min("_a")),
    "max": (lambda v: [F.max(v).alias("_a")], lambda: F.max("_a")),
    "last": (
        lambda v: [F.max_by(v, write_order()).alias("_a"), F.max(write_order()).alias("_b")],
        lambda: F.max_by("_a", "_b"),
    ),
}


def latest_only(runs: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """What the target tier holds after all runs: the last run of a bucket wins."""
    return runs.groupBy(*by, "time").agg(F.max_by("value", "run_at").alias("value"))
