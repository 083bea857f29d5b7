"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. Within a source a document is expected to be taken ``e = min(most_copies, c * w)``
times, where w falls with its length (so that few very long documents do not make up a source) and c makes the expected
words equal the target. Its whole copies are certain; the fraction p = e - floor(e) is its chance of one more, drawn by
Pareto order sampling: documents are ranked by the odds of a random number divided by the odds of p, and the lowest
ranks are taken until the source has its words. So the size of the sample is fixed (to half a document), chances are
unequal, and the random numbers come from id and text: reruns agree.

All of it is DataFrame code. Ranks are cut into fixed slices; sums per slice say in which slice a source's cut lies, and
only the rows of that slice are ordered, so no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import free_name, stored

WORDS = "[^\\x20\\x09-\\x0D]+"
SLICES = 1024


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def _draw(identifier: Column, text: Column) -> Column:
    """A number above 0 and below 1 from 52 bits of a digest."""
    key = F.concat(F.coalesce(identifier.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, have the weights in turn. The total is ``share`` of all sizes; no target is above
    ``most`` times its source, and what is cut off goes to the others by weight. Filled from the source that is first
    to be full: the level at which all are served is the greatest of the levels that assume the earlier ones are full.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", turn).withColumn("full", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("full").over(earlier), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level).withColumn("best", F.max("level").over(whole))
    return levels.select("source", "source_size", F.least("full", F.col("best") * F.col("weight")).alias("target"))


def mix(
    documents: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most_copies: float = 2.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, expected, copies, draw) of every row of ``documents``.

    Sizes count words. A document without words is taken 0 times. Null sources are one source. Rows with equal id and
    text draw the same number and are taken alike. An empty table gives no rows.
    """
    text = F.col(text_column).cast("string")
    narrow = stored(
        documents.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).cast("string").alias("source"),
            _size(text).alias("size"),
            _draw(F.col(id_column), text).alias("draw"),
        ).withColumn("w", F.expr("1D / shiftleft(1L, CAST(floor(length(bin(size)) / 4) AS INT))")),
        "mix",
    )
    # tables of a few rows per source are stored where two others are made from them: a plan that nests them all has
    # hundreds of nodes, and the driver holds it again for every stage that ends
    bands = stored(narrow.groupBy("source", "w").agg(F.sum("size").alias("words")), "mix-bands")
    sizes = bands.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most_copies), "mix-targets")
    plan = stored(_plan(bands, targets, most_copies), "mix-plan")
    rows = narrow.join(plan, narrow.source.eqNullSafe(plan.plan_source), "left").drop("plan_source")
    rows = _ranked(rows, most_copies)
    slices = rows.where("p > 0 AND size > 0").groupBy("source", "slice").agg(F.sum("size").alias("words"))
    certain = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    cuts = stored(_cuts(rows, slices, certain), "mix-cuts")
    done = rows.join(cuts, rows.source.eqNullSafe(cuts.cut_source), "left")
    more = (F.col("p") > 0) & (F.col("size") > 0) & ((F.col("slice") < F.col("cut_slice")) | (F.col("rank") <= F.col("cut_rank")))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).otherwise(0)
    return done.select("doc_id", "source", "size", "source_size", "target", F.col("e").alias("expected"), copies.cast("bigint").alias("copies"), "draw")


def _plan(bands: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """c of each source: the greatest of the levels that assume the heavier bands are at ``most`` copies."""
    joined = bands.where("words > 0").join(targets.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))
    own = Window.partitionBy("plan_source").orderBy(F.desc("w"))
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("plan_source")
    level = (F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(earlier), F.lit(0))) / (
        F.sum(F.col("w") * F.col("words")).over(whole) - F.coalesce(F.sum(F.col("w") * F.col("words")).over(earlier), F.lit(0.0))
    )
    levels = joined.withColumn("level", level)
    solved = levels.groupBy("plan_source").agg(F.max("level").alias("c"))
    known = targets.withColumnRenamed("source", "plan_source")
    both = known.join(solved.withColumnRenamed("plan_source", "c_source"), F.col("plan_source").eqNullSafe(F.col("c_source")), "left")
    return both.select("plan_source", "source_size", "target", F.coalesce("c", F.lit(0.0)).alias("c"))


def _ranked(rows: DataFrame, most: float) -> DataFrame:
    e = F.least(F.lit(float(most)), F.col("c") * F.col("w"))
    rows = rows.withColumn("e", e).withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
    # odds of the draw over odds of p, mapped to 0..1 without changing the order
    up, down = F.col("draw") * (1 - F.col("p")), (1 - F.col("draw")) * F.col("p")
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, up / (up + down)))
    return rows.withColumn("slice", F.least(F.floor(F.col("rank") * SLICES), F.lit(SLICES - 1)))


def _cuts(rows: DataFrame, slices: DataFrame, certain: DataFrame) -> DataFrame:
    """Of each source, the slice in which its words are reached, and the last rank taken there."""
    named = certain.select(F.col("source").alias("cut_source"), (F.col("target") - F.col("certain")).alias("room"))
    order = Window.partitionBy("source").orderBy("slice")
    sums = slices.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
    placed = named.join(sums, named.cut_source.eqNullSafe(sums.source), "left")
    # slices that fit whole lie below the cut; a source whose slices all fit has its cut above the last
    at = stored(
        placed.groupBy("cut_source").agg(
            F.first("room").alias("room"),
            F.coalesce(F.min(F.when(F.col("upto") > F.col("room"), F.col("slice"))), F.lit(SLICES)).alias("cut_slice"),
            F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto"))).alias("fits"),
        ),
        "mix-at",
    )
    within = at.where(F.col("cut_slice") < SLICES)
    inside = rows.where("p > 0 AND size > 0").select("source", "slice", "rank", "size", "doc_id").join(
        within, rows.source.eqNullSafe(F.col("cut_source")) & (F.col("slice") == F.col("cut_slice"))
    )
    run = Window.partitionBy("cut_source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.coalesce("fits", F.lit(0)) + F.sum("size").over(run) - F.col("size") / 2
    taken = inside.withColumn("middle", middle).where(F.col("middle") <= F.col("room"))
    last = taken.groupBy(F.col("cut_source").alias("last_source")).agg(F.max("rank").alias("cut_rank"))
    return at.join(last, F.col("cut_source").eqNullSafe(F.col("last_source")), "left").select("cut_source", "cut_slice", "cut_rank")


def take(documents: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of ``documents``, each as often as it is taken, with the columns of ``documents``.

    Copies are decided by id and text, so they come back to the rows by id and draw. Columns of any name come through; null
    ids, texts and sources are values like others, a null or empty text is never taken, and an empty table gives no rows.
    """
    identifier, text = settings.get("id_column", "doc_id"), settings.get("text_column", "text")
    own, id_, draw, source_, copies = (free_name(documents, f"mix_{n}") for n in ("own", "id", "draw", "source", "copies"))
    decided = mix(documents, **settings).where("copies > 0")
    decided = decided.groupBy(F.col("doc_id").alias(id_), F.col("draw").alias(draw), F.col("source").alias(source_)).agg(F.max("copies").alias(copies))
    source = settings.get("source_column", "source")
    marked = documents.withColumn(own, _draw(F.col(identifier), F.col(text).cast("string")))
    both = marked.join(
        decided,
        (F.col(own) == F.col(draw)) & F.col(identifier).eqNullSafe(F.col(id_)) & F.col(source).cast("string").eqNullSafe(F.col(source_)),
    )
    columns = [F.col(c) for c in documents.columns]
    return both.select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies)).drop(copies)
