"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a ring; a document hashes to a place on it and belongs to the next point
clockwise. No shard takes more than ``(1 + slack)`` of the mean load in bytes: what finds its shard full goes on clockwise to the
next shard with room. So loads are near equal, and a change of shards moves little.

The ring has a fixed number of places. Documents of one place see the shards in the same order, so places are what is
dealt out, the heaviest first: only their loads, a table of bounded size whatever the data, meet on the driver, and each
document looks its place up.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import stored

#: Places of the ring: 2 to this power.
RING_BITS = 15


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, in ring order. A further shard moves no point of the others."""
    found = {}
    for shard in range(shards):
        for k in range(virtual_nodes):
            digest = hashlib.md5(f"shard {shard} node {k}".encode()).digest()
            found.setdefault(int.from_bytes(digest[:4], "big") >> (32 - RING_BITS), shard)
    return sorted(found.items())


def clockwise(points: list[tuple[int, int]], arc: int) -> list[int]:
    """Shards in the order in which documents of an arc meet them."""
    seen: dict[int, None] = {}
    for _, shard in points[arc:] + points[:arc]:
        seen.setdefault(shard)
    return list(seen)


def deal(loads: list[tuple[int, int]], shards: int, virtual_nodes: int, slack: float) -> dict[int, int]:
    """Shard of each place, from (place, load): the first clockwise that still has room.

    Heavier places come first, equal ones in ring order. If no shard has room (a few huge documents can do that), the
    place goes to the shard with the least load, the first of these clockwise.
    """
    points = ring_points(shards, virtual_nodes)
    starts = [p for p, _ in points]
    room = (1 + slack) * sum(load for _, load in loads) / shards
    held, out, orders = [0] * shards, {}, {}
    for place, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        arc = bisect.bisect_left(starts, place) % len(points)
        order = orders.get(arc) or orders.setdefault(arc, clockwise(points, arc))
        shard = next((s for s in order if held[s] + load <= room), None)
        if shard is None:
            shard = min(order, key=lambda s: held[s])
        held[shard] += load
        out[place] = shard
    return out


def shard(
    documents: DataFrame,
    shards: int = 8,
    virtual_nodes: int = 64,
    slack: float = 0.005,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, place, shard, slot) of every row; slots run from 0 without a gap in each shard.

    Size is the text's UTF-8 bytes plus 1 (a null text has none; its checksum is that of no bytes). The place on the ring
    comes from id, size and checksum, so null or repeated ids spread too; fully equal rows share a place. Empty table: no rows.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    rows = documents.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "size", "text_crc32"), 64 - RING_BITS).cast("int")
    held = stored(rows.withColumn("place", place), "places")
    loads = held.groupBy("place").agg(F.sum("size").alias("load"), F.count("*").alias("n")).orderBy("place").collect()
    dealt = deal([(r.place, r.load) for r in loads], shards, virtual_nodes, slack)
    firsts, used = [], [0] * shards
    for r in loads:
        s = dealt[r.place]
        firsts.append((r.place, s, used[s]))
        used[s] += r.n
    # one row of 16 bytes for each place of the ring at most
    lookup = documents.sparkSession.createDataFrame(firsts, "place int, shard int, first bigint")
    own = Window.partitionBy("place").orderBy("doc_id", "text_crc32", "size")
    numbered = held.withColumn("__n", F.row_number().over(own) - 1).join(F.broadcast(lookup), "place")
    return numbered.select("doc_id", "size", "text_crc32", "place", "shard", (F.col("first") + F.col("__n")).cast("bigint").alias("slot"))
