"""Last-known-value operations along an order, for keys of any size.

A window per sensor would put all rows of a sensor in one task. Here every key is cut along its order into slices of one
fixed width, an hour by default:

1. inside a slice a window gives the last value,
2. one aggregate per slice (combined map-side) gives the value each slice ends with,
3. a window over these slice ends (8,766 a year and key) gives what each slice starts with, and that joins the slice as a
   seed row.

The rows are shuffled once, by (key, slice), as for a plain window; nothing is counted first, no join and no Python is
involved. Where the busiest key has too many rows in an hour for one task, give a smaller width.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Width of a slice.
HOUR_US = 3_600_000_000
# Above the span of a BIGINT, so that position * SEQ_SPAN + sequence orders by position first.
SEQ_SPAN = Decimal(2 * 10**19)


def micros(time: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(time.cast("timestamp"))


def order_key(position: Column, seq: Column) -> Column:
    """One DECIMAL that orders by (position, seq).

    ``max_by`` over a struct would need a sort; over a fixed-width number it stays a hash aggregate.
    """
    return position.cast("decimal(18,0)") * F.lit(SEQ_SPAN) + seq.cast("decimal(19,0)")


def slice_start(position: Column, width: int) -> Column:
    """Start of the slice that a position lies in; slices of a key are runs of consecutive rows."""
    return position - F.pmod(position, F.lit(width))


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    position: Column,
    seq: Column,
    values: dict[str, Column],
    strict: bool = False,
    rising: bool = False,
    width: int = HOUR_US,
) -> DataFrame:
    """Add, for each name in ``values``, the last non-NULL value at or before the row (before it, if ``strict``).

    ``position`` is a BIGINT along which rows of a key are ordered; ``seq`` decides between equal positions. Values
    that never fall along the order (``rising``), such as the time itself, are cheaper: a slice ends with the largest.
    ``width`` of a slice, in units of ``position``, changes how the work is cut, never the result.
    """
    keys = list(keys)
    columns = df.columns
    sources = {name: f"_src_{name}" for name in values}
    rows = df.select(
        "*",
        position.cast("bigint").alias("_pos"),
        seq.cast("bigint").alias("_seq"),
        *[expr.alias(sources[name]) for name, expr in values.items()],
    )
    rows = rows.withColumn("_slice", slice_start(F.col("_pos"), width))
    at = order_key(F.col("_pos"), F.col("_seq"))
    slice_key = [*keys, "_slice"]
    # every slice takes part, also one without values, for it needs a seed
    ends = rows.groupBy(*slice_key).agg(
        *[
            (F.max(s) if rising else F.max_by(s, F.when(F.col(s).isNotNull(), at))).alias(s)
            for s in sources.values()
        ]
    )
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    seeds = ends.select(
        *slice_key, *[F.last(s, ignorenulls=True).over(earlier).alias(s) for s in sources.values()]
    ).where(reduce(or_, [F.col(s).isNotNull() for s in sources.values()]))
    seeded = rows.withColumn("_real", F.lit(True)).unionByName(
        seeds.withColumn("_real", F.lit(False)), allowMissingColumns=True
    )
    # a seed has no position, so it sorts before the rows of its slice
    upto = (
        W.partitionBy(*slice_key)
        .orderBy(F.col("_pos").asc_nulls_first(), "_seq")
        .rowsBetween(W.unboundedPreceding, -1 if strict else W.currentRow)
    )
    carried = seeded.select(
        *columns, "_real", *[F.last(s, ignorenulls=True).over(upto).alias(name) for name, s in sources.items()]
    )
    return carried.where("_real").drop("_real")
