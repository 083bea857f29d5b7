"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

#: Edges that one partition of those kept between rounds holds.
PART_EDGES = 100_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge to another one; component is its smallest reachable node.

    Each round links larger neighbours of a node to its smallest neighbour, then smaller ones, until all edges are stars.
    Every step is a minimum (combined before the shuffle) and a join back (a hot node is split by adaptive execution), so no
    neighbourhood is ever gathered. Rounds grow with the logarithm of a component's size. Edges never become more, so what is
    kept between rounds has partitions by their number. Edges that fit into one partition go through the same rounds there
    without any shuffle, for each costs the driver a thread and records of its tasks. Null nodes and loops have no edge. No
    edges: no rows.
    """
    held = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v AND u > v")
        .distinct()
    )
    parts = None
    while True:
        count, waiting = _open(held if parts is None else held.coalesce(parts))
        if not waiting:
            break
        parts = 1 + count // PART_EDGES
        few = held.coalesce(parts)
        held = cut_lineage((_round if parts > 1 else _round_in_one)(few).distinct().coalesce(parts))
    members = held.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())


def _round(few: DataFrame) -> DataFrame:
    """Edges (u, v) after a large and a small star."""
    either = few.unionByName(few.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = either.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("low"))
    large = few.join(least, "v").select("u", F.least("v", "low").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("low"))
    down = large.join(low, "u").select("low", F.explode(F.array("u", "v")).alias("u")).where("u <> low")
    return down.select("u", F.col("low").alias("v"))


def _round_in_one(few: DataFrame) -> DataFrame:
    """The same within one partition: minima as windows, which there need no shuffle as joins would."""
    both = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))
    either = few.select(F.inline(both)).withColumn("low", F.min("y").over(W.partitionBy("x")))
    large = either.where("y > x").select(F.col("y").alias("u"), F.least("x", "low").alias("v")).where("u <> v").distinct()
    down = large.withColumn("low", F.min("v").over(W.partitionBy("u")))
    return down.select("low", F.explode(F.array("u", "v")).alias("u")).where("u <> low").select("u", F.col("low").alias("v"))


def stars(groups: DataFrame, a: str, b: str) -> DataFrame:
    """Edges from the members of groups (node, component) to their components: found groups go on from here in few rounds."""
    return groups.where("node <> component").select(F.col("node").alias(a), F.col("component").alias(b))


def _open(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of nodes with two smaller neighbours or with a smaller and a larger one: none if all are stars."""
    either = F.array(*[F.struct(F.col(c).alias("node"), F.lit(up).alias("up")) for c, up in (("u", 1), ("v", 0))])
    nodes = edges.select(F.inline(either)).groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    row = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("least") == 0))).first()
    return row[0], row[1]
