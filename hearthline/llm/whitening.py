"""Whitening of vectors through distributed block matrices.

Entries become whole numbers and each distinct vector counts once. The centred vectors are indexed without gaps and become a
``BlockMatrix``; its transpose times itself is the scatter matrix, whose eigenvectors are found on the driver (as many numbers as
a vector has entries, squared); the block matrix times the whitening matrix projects the rows. Sums, the number of vectors and
deviations are exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import give_back, map_arrow, stored
from hearthline.session import ship


@dataclass(frozen=True)
class Settings:
    """``step``: entries are counted in 1/step. A block has ``block_rows`` rows at most; the driver holds the number of each block."""

    components: int = 4
    step: int = 256
    block_rows: int = 1024


_WIDTHS = (2, 4, 8)
#: Blocks whose products one task adds up.
SPLIT_BLOCKS = 16


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes of the narrowest width each: equal rows have equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    fits = [(np.iinfo(f"<i{w}").min <= low) & (high <= np.iinfo(f"<i{w}").max) for w in _WIDTHS]
    width = np.select(fits, _WIDTHS)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        at, size = np.flatnonzero(width == w), w * x.shape[1]
        data = x[at].astype(f"<i{w}").tobytes()
        for k, i in enumerate(at.tolist()):
            out[i] = data[k * size : (k + 1) * size]
    return out


def _unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), np.int64)
    for width in _WIDTHS:
        at = [k for k, r in enumerate(rows) if len(r) == width * dims]
        if at:
            out[at] = np.frombuffer(b"".join(rows[k] for k in at), f"<i{width}").reshape(-1, dims)
    return out


def whole_vectors(vectors: DataFrame, step: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, dims, x): entries as floor(step * entry), packed; without vectors that are null or empty or have null, infinite or NaN entries.

    Entries whose product leaves 64 bits count as infinite.
    """

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column(1)
        values = lists.flatten()
        flat = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * step)  # null is NaN here
        good = np.concatenate([[0], np.cumsum(~(np.isfinite(flat) & (np.abs(flat) < 2.0**63)))])  # bad entries so far
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        whole = (sizes > 0) & (good[ends] == good[ends - sizes])
        at, dims, made = [], [], []
        for d in np.unique(sizes[whole]).tolist():
            own = np.flatnonzero(whole & (sizes == d))
            at += own.tolist()
            dims += [d] * len(own)
            made += _packed(flat[(ends[own] - d)[:, None] + np.arange(d)].astype(np.int64))
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), pa.array(dims, pa.int32()), pa.array(made, pa.binary())], names=names)

    kind = vectors.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("dims", T.IntegerType()), T.StructField("x", T.BinaryType())])
    names = schema.names
    return map_arrow(vectors.select(F.col(id_column), F.col(vector_column).cast("array<double>")), batch, schema)


def _blocks(vectors: DataFrame, height: int) -> DataFrame:
    """(dims, n, x, place): distinct vectors of one length, ``height`` to a row as a block, fewer in the last one of a task."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for dims, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = held.setdefault(dims, [])
                own.append(x)
                if len(own) == height:
                    yield made(dims, held.pop(dims))
        for dims, own in held.items():
            yield made(dims, own)
        give_back()

    def made(dims: int, own: list[bytes]) -> pa.RecordBatch:
        data = _unpacked(own, dims).astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([data], pa.binary())], names=["dims", "n", "x"])

    ship(vectors.sparkSession)
    return vectors.mapInArrow(blocks, "dims int, n bigint, x binary").withColumn("place", F.monotonically_increasing_id())


def _read(block: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(block, "<i8").reshape(-1, dims)


def _sums(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    """Sums of each place over the vectors of a batch of blocks."""
    if not rows.num_rows:
        return None
    dims = rows.column(0)[0].as_py()
    totals = [0] * dims
    for block in rows.column(1).to_pylist():
        x = _read(block, dims)
        small = int(max(-x.min(), x.max())) < (1 << 62) // len(x)
        own = x.sum(axis=0).tolist() if small else [sum(map(int, c)) for c in x.T]
        totals = [a + b for a, b in zip(totals, own)]
    return pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))], names=["place", "total"])


@dataclass(frozen=True)
class Whitening:
    """What the distinct vectors give: their number, sums, eigenvalues (falling) and unit eigenvectors (columns)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray

    def matrix(self, components: int) -> np.ndarray:
        """Columns that project on the first components, to unit variance; fewer if the others have no variance."""
        least = max(self.values[0], 0) * len(self.sums) * np.finfo(float).eps
        k = int((self.values[:components] > least).sum()) if self.values[0] > 0 else 0
        return self.vectors[:, :k] / np.sqrt(self.values[:k])


def _block_matrix(blocks: DataFrame, n_blocks: int, height: int, n: int, sums: list[int]) -> BlockMatrix:
    """The centred vectors; a block that is not full has rows of zeros, which add nothing to products."""
    dims = len(sums)

    def centred(row: Row) -> tuple[tuple[int, int], DenseMatrix]:
        entries = np.zeros((height, dims))
        x = _centred(_read(row["x"], dims), n, sums).astype(np.float64) / n
        entries[: len(x)] = x
        return (row["index"], 0), DenseMatrix(height, dims, entries.ravel(order="F"))

    made = BlockMatrix(blocks.select("index", "x").rdd.map(centred), height, dims, n_blocks * height, dims)
    return made.persist(StorageLevel.MEMORY_AND_DISK)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as 64-bit numbers where squares of them can be summed in 64 bits, else as Python's."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if most * most * len(sums) < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """Product whose inner dimension is shared out over ``splits`` tasks: a small product of long matrices is no single task."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def whiten(vectors: DataFrame, settings: Settings = Settings(), id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """Per vector that counts: id, ``n``, ``deviation``, ``z`` (its whitened entries) and ``identity_error``; and what was found.

    The covariance is over the distinct vectors, divisor n. ``deviation`` is the sum of (n * x - sums) squared, null if it leaves 64
    bits. ``z`` is shorter than ``components`` where the rest has no variance (one distinct vector: empty). Vectors of another length
    than the most frequent one (ties: the longest) do not count. Copies share a row of the matrix; repeated and null ids give a row
    each. Without vectors there are no rows and nothing is found. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, settings.step, id_column, vector_column)
    schema = T.StructType(
        [
            T.StructField(id_column, vectors.schema[id_column].dataType), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
            T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("identity_error", T.DoubleType()),
        ]
    )
    distinct = rows.select("dims", "x").distinct()
    blocks = stored(_blocks(distinct, settings.block_rows), "vectors")
    top = blocks.groupBy("dims").agg(F.sum("n").alias("n"), F.max("n").alias("height")).orderBy(F.desc("n"), F.desc("dims")).first()
    if top is None:
        return spark.createDataFrame([], schema), None
    dims, n, height = top["dims"], top["n"], top["height"]
    own = blocks.where(F.col("dims") == dims)
    totals = map_arrow(own.select("dims", "x"), _sums, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total")).collect()
    sums = [int(r["total"]) for r in sorted(totals, key=lambda r: r["place"])]
    own, n_blocks = _indexed(own)
    matrix = _block_matrix(own, n_blocks, height, n, sums)
    splits = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // SPLIT_BLOCKS))
    scatter = _times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray() / n
    values, eigen = np.linalg.eigh((scatter + scatter.T) / 2)
    found = Whitening(n, tuple(sums), np.maximum(values[::-1], 0), eigen[:, ::-1])
    weights = found.matrix(min(settings.components, dims))
    k = weights.shape[1]
    error = 0.0
    if k:
        one = spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, k, weights.ravel(order="F")))], 1)
        projected = matrix.multiply(BlockMatrix(one, dims, k))
        z = stored(spark.createDataFrame(projected.blocks.flatMap(lambda b: _rows_of(b, height)), "index bigint, z array<double>"), "whitened")
        error = _identity_error(z, k, n)
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)

    def vectors_of(part: pa.RecordBatch) -> pa.RecordBatch | None:
        index, data, total = [], [], []
        for i, block in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            x = _read(block, dims)
            index += range(i * height, i * height + len(x))
            data += _packed(x)
            total += (_centred(x, n, sums) ** 2).sum(axis=1).tolist()
        exact = pa.array([t if t < 1 << 63 else None for t in total], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(data, pa.binary()), exact], names=["index", "x", "deviation"])

    of_vector = map_arrow(own.select("index", "x"), vectors_of, "index bigint, x binary, deviation bigint")
    of_vector = of_vector.join(z, "index") if k else of_vector.withColumn("z", F.array().cast("array<double>"))
    of_vector = of_vector.select("x", "deviation", "z")
    out = rows.where(F.col("dims") == dims).select("id", "x").join(of_vector, "x")
    return out.select(F.col("id").alias(id_column), F.lit(n).cast("bigint").alias("n"), "deviation", "z", F.lit(error).alias("identity_error")), found


def by_component(rows: DataFrame, found: Whitening | None, settings: Settings = Settings()) -> DataFrame:
    """A row for each vector of ``whiten`` and component from 1: ``whitened`` (null without variance) and ``explained`` of the variance.

    ``explained`` is null if all vectors are one.
    """
    values = np.zeros(0) if found is None else found.values
    shares = [float(e / values.sum()) if values.sum() else None for e in values[: settings.components]]
    listed = F.array(*[F.lit(s).cast("double") for s in shares]).cast("array<double>")
    others = [c for c in rows.columns if c not in ("z", "identity_error")]
    parts = rows.select(*others, "z", "identity_error", F.posexplode(listed).alias("component", "explained"))
    whitened = F.get("z", F.col("component")).alias("whitened")
    return parts.select(others[0], (F.col("component") + 1).alias("component"), *others[1:], whitened, "explained", "identity_error")


def _indexed(blocks: DataFrame) -> tuple[DataFrame, int]:
    """``index`` without gaps from the ``place`` that a block was written at, and the number of blocks.

    A place is the number of the task that wrote it and one within it; the driver gets one count a task.
    """
    inside = F.col("place").bitwiseAND((1 << 33) - 1)
    counted = blocks.groupBy(F.shiftright("place", 33).alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max(inside).alias("most")).collect()
    if any(r["most"] + 1 != r["n"] for r in counted):  # blocks of another length lie between: number the rest anew
        return _indexed(stored(blocks.withColumn("place", F.monotonically_increasing_id()), "vectors"))
    starts, total = {}, 0
    for r in sorted(counted, key=lambda r: r["task"]):
        starts[r["task"]] = total
        total += r["n"]

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        place = part.column(0).to_numpy()
        base = np.array([starts[t] for t in (place >> 33).tolist()], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(base + (place & ((1 << 33) - 1))), part.column(1)], names=["index", "x"])

    return map_arrow(blocks.select("place", "x"), batch, "index bigint, x binary"), total


def _rows_of(block: tuple[tuple[int, int], DenseMatrix], height: int) -> Iterator[tuple[int, list[float]]]:
    (i, _), matrix = block
    for r, row in enumerate(matrix.toArray().tolist()):
        yield i * height + r, row


def _identity_error(z: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of the n whitened rows minus the identity; rows of zeros add nothing."""
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.sum(F.col("z")[i]).alias(f"s{i}") for i in range(k)] + [F.sum(F.col("z")[i] * F.col("z")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    r = z.agg(*sums).first()
    return max(abs(r[f"p{i}_{j}"] / n - r[f"s{i}"] / n * r[f"s{j}"] / n - (i == j)) for i, j in pairs)
