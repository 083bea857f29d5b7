"""Near-duplicate vectors by cross-polytope hashing.

A vector of unit length is turned by fast Hadamard transforms with random signs; its hash is the axis (with sign) that
it then lies closest to. ``rotations`` such hashes make a bucket of one of ``tables`` tables. Multiprobe: a vector enters
not only its own bucket but also those in which one or more hashes are replaced by the next closest axes, in the order of
what that costs. Vectors that share any bucket are candidates, and every candidate pair is verified by its cosine in
double precision.

Buckets are compared in blocks: one with many vectors is cut by hash, and each pair of blocks is a task of its own, in
which NumPy multiplies matrices. Pairs are not emitted; a block pair yields link counts per vector, and for each vector one
edge within its cluster. A pair that shares several buckets counts in the first of them only. Equal vectors are
collapsed before, as one with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import map_arrow, stored
from hearthline.llm.components import components
from hearthline.session import ship


@dataclass(frozen=True)
class Settings:
    least_cosine: float = 0.98
    tables: int = 6
    rotations: int = 3
    probes: int = 4
    block: int = 256
    seed: int = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two of columns), keeping lengths."""
    n = x.shape[1]
    out = x.copy()
    h = 1
    while h < n:
        out = out.reshape(len(x), n // (2 * h), 2, h)
        out = np.stack((out[:, :, 0] + out[:, :, 1], out[:, :, 0] - out[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return out / np.sqrt(n)


def buckets(unit: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Codes (rows, tables, probes) of vectors of unit length; a code holds the table's number, and the first is the own bucket."""
    rows, d = unit.shape
    n = 1 << max(1, (d - 1).bit_length())
    wide = np.zeros((rows, n))
    wide[:, :d] = unit
    rng = np.random.Generator(np.random.PCG64([s.seed, n]))
    out = np.empty((rows, s.tables, s.probes), dtype=np.int64)
    depth = min(3, 2 * n)
    for t in range(s.tables):
        axes, costs = [], []
        for _ in range(s.rotations):
            y = wide
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size=n))
            both = np.concatenate((y, -y), axis=1)
            near = np.argpartition(-both, depth - 1, axis=1)[:, :depth]
            value = np.take_along_axis(both, near, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            axes.append(np.take_along_axis(near, order, axis=1))
            value = np.take_along_axis(value, order, axis=1)
            costs.append(value[:, :1] - value)
        # all ways to choose one of the nearest axes for each rotation, cheapest first
        ways = np.array(np.meshgrid(*[range(depth)] * s.rotations, indexing="ij")).reshape(s.rotations, -1).T
        ways = ways[np.argsort(ways.sum(axis=1), kind="stable")]
        cost = sum(costs[r][:, ways[:, r]] for r in range(s.rotations))
        best = np.argsort(cost, axis=1, kind="stable")[:, : s.probes]
        code = np.full(best.shape, t, dtype=np.int64)
        for r in range(s.rotations):
            code = code * (2 * n) + np.take_along_axis(axes[r], ways[best, r], axis=1)
        out[:, t, : best.shape[1]] = code
        out[:, t, best.shape[1] :] = code[:, :1]
    return out


def _units(column: pa.Array) -> tuple[list[np.ndarray | None], list[bool]]:
    """Rows of a list column in double precision and unit length; None where null, zero or not finite."""
    out: list[np.ndarray | None] = []
    for value in column.to_pylist():
        unit = None
        if value and None not in value:
            x = np.array(value, dtype=np.float64)
            big = np.abs(x).max()
            if np.isfinite(big) and big > 0:
                x = x / big
                unit = x / np.sqrt(x @ x)
        out.append(unit)
    return out, [u is not None for u in out]


def hashed(vectors: DataFrame, s: Settings, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(vec_id, label, unit, codes); unit and codes are null for vectors that link with nothing."""

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        units, good = _units(part.column(2))
        labels = part.column(1).to_pylist()
        good = [g and label is not None for g, label in zip(good, labels)]
        codes: list = [None] * len(units)
        widths: dict[int, list[int]] = {}
        for i, g in enumerate(good):
            if g:
                widths.setdefault(len(units[i]), []).append(i)
        for own in widths.values():
            for i, code in zip(own, buckets(np.stack([units[i] for i in own]), s).reshape(len(own), -1)):
                codes[i] = np.unique(code)
        raw = [u.tobytes() if g else None for u, g in zip(units, good)]
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(raw, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], ["vec_id", "label", "unit", "codes"]
        )

    chosen = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("v")
    )
    return map_arrow(chosen, batch, "vec_id bigint, label string, unit binary, codes array<bigint>")


_MATCH = "node bigint, linked bigint, other bigint"


def _compare(nodes: np.ndarray, weights: np.ndarray, x: np.ndarray, side: np.ndarray, codes: list[np.ndarray], code: int, one: bool, s: Settings):
    """Links of one block pair: (node, weight linked, a node of its cluster).

    ``side``: block of each row, 0 or 1; within one block all pairs are compared, between two only crossing ones.
    """
    left, right = (np.arange(len(nodes)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(left) or not len(right):
        return [], [], []
    near = x[left] @ x[right].T >= s.least_cosine
    if one:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    if not len(a):
        return [], [], []
    # exact cosine of what is close, summed alike in every block
    exact = np.einsum("ij,ij->i", x[a], x[b]) >= s.least_cosine
    a, b = a[exact], b[exact]
    # only the first bucket that a pair shares counts it
    width = max(map(len, codes))
    table = np.full((len(codes), width), -1, dtype=np.int64)
    for i, c in enumerate(codes):
        c = c[c < code]
        table[i, : len(c)] = c
    for k in range(width):
        if not len(a):
            break
        probe = table[a, k]
        earlier = ((table[b] == probe[:, None]) & (probe >= 0)[:, None]).any(axis=1)
        a, b = a[~earlier], b[~earlier]
    if not len(a):
        return [], [], []
    total = np.bincount(a, weights=weights[b], minlength=len(nodes)) + np.bincount(b, weights=weights[a], minlength=len(nodes))
    low = np.arange(len(nodes))
    while True:
        # smallest position reachable within the block pair
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    used = np.unique(np.concatenate((a, b)))
    return nodes[used].tolist(), total[used].astype(np.int64).tolist(), nodes[low[used]].tolist()


def near_duplicates(
    vectors: DataFrame, settings: Settings = Settings(), id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are compared if their labels are equal and not null. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, and neither do vectors of different width. Rows with the same vector and label
    link with each other. A null id is never a component's smallest; a component without ids has none. Empty table: no rows.
    """
    s = settings
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(hashed(vectors, s, id_column, vector_column, label_column).withColumn("node", F.when(F.col("unit").isNotNull(), F.xxhash64("label", "unit"))), "hashed")
    good = rows.where("node IS NOT NULL")
    classes = good.groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    # one row per distinct vector: its smallest id, or any row if it has none
    bodies = good.groupBy("node").agg(F.first("unit").alias("unit"), F.first("codes").alias("codes"))
    entries = bodies.select("node", F.explode("codes").alias("code")).join(good.select("node", "label").distinct(), "node")
    full = entries.groupBy("label", "code").agg(F.count("*").alias("n")).where("n > 1")
    shared = entries.join(full.withColumnsRenamed({"label": "l", "code": "c"}), (F.col("label") == F.col("l")) & (F.col("code") == F.col("c")))
    blocks = F.ceil(F.col("n") / s.block).cast("int")
    dealt = shared.select("label", "code", "node", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("node", "code"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "code", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).cast("int").alias("side"), "node")
    carried = dealt.join(bodies, "node").join(classes.select("node", "weight"), "node")
    sorted_rows = carried.withColumn("cell", F.xxhash64("label", "code", "i", "j")).repartition("cell").sortWithinPartitions("cell", "label", "code", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, code, i, j), part in _runs(batches, ("label", "code", "i", "j")):
            x = np.frombuffer(b"".join(part["unit"]), dtype=np.float64)
            if len({len(u) for u in part["unit"]}) > 1:
                groups: dict[int, list[int]] = {}
                for at, u in enumerate(part["unit"]):
                    groups.setdefault(len(u), []).append(at)
            else:
                groups = {len(part["unit"][0]): list(range(len(part["unit"])))}
            for size, at in groups.items():
                x = np.frombuffer(b"".join(part["unit"][k] for k in at), dtype=np.float64).reshape(len(at), size // 8)
                pick = lambda name: np.array([part[name][k] for k in at], dtype=np.int64)  # noqa: B023, E731
                codes = [np.array(part["codes"][k], dtype=np.int64) for k in at]
                found = _compare(pick("node"), pick("weight"), x, pick("side"), codes, code, i == j, s)
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["node", "linked", "other"])

    found = stored(sorted_rows.mapInArrow(compare, _MATCH), "links")
    links = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    member = components(found.where("node <> other"), "node", "other")
    lows = classes.join(member, "node", "left").select("node", "weight", "low", F.coalesce("component", "node").alias("component"))
    least = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    known = lows.join(least, "component").join(links, "node", "left").select("node", "component_id", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Groups of neighbouring rows with equal keys, across batches."""
    last, held = None, None
    for batch in batches:
        columns = batch.to_pydict()
        names = list(columns)
        marks = list(zip(*(columns[k] for k in keys)))
        begin = 0
        for at in range(1, len(marks) + 1):
            if at < len(marks) and marks[at] == marks[begin]:
                continue
            part = {n: columns[n][begin:at] for n in names}
            if marks[begin] == last:
                for n in names:
                    held[n].extend(part[n])
            else:
                if held is not None:
                    yield last, held
                last, held = marks[begin], part
            begin = at
    if held is not None:
        yield last, held
