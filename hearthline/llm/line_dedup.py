"""Lines that recur in many documents, dropped everywhere but in the last document that holds them.

Each line long enough becomes a record (hash of its key, document, position) without text. Records are range-partitioned by hash
and document and sorted by hash, document (largest first) and position, so each task streams over the documents of a hash, the
first being the one that keeps the line. A hash of a very common line is spread over several tasks: what a task cannot decide
alone, as its first or last hash may go on in a neighbour, it hands on as waiting records and a count of documents (two counts a
task at most). The dropped positions become one compressed keep bitmap per document; texts are not part of any of this.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import give_back, map_arrow, stored
from hearthline.session import ship


@dataclass(frozen=True)
class Settings:
    """Keys of at least ``least_points`` code points in at least ``least_documents`` documents are dropped."""

    least_points: int = 40
    least_documents: int = 5


_DROPPED, _WAITING, _COUNT = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _long(key: bytes, least: int) -> bool:
    if len(key) < least:
        return False
    return key.isascii() or len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least


def _identified(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return documents.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def line_records(documents: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(high, low, id, text_key, n_lines, at) of each line with a key long enough; ``high`` and ``low`` hash the key."""
    least = settings.least_points

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        digests, of, sizes, at = [], [], [], []
        for k, text in enumerate(rows.column(2).to_pylist()):
            lines = text.split(b"\n")
            for i, line in enumerate(lines):
                key = line.strip()
                if _long(key, least):
                    digests.append(xxhash.xxh3_128_digest(key.lower()))
                    of.append(k)
                    sizes.append(len(lines))
                    at.append(i)
        hashes = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        rows_of = pa.array(of, pa.int64())
        columns = [
            pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), rows.column(0).take(rows_of), rows.column(1).take(rows_of),
            pa.array(sizes, pa.int32()), pa.array(at, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    found = _identified(documents, id_column, text_column)
    schema = _record_schema(found.schema["id"].dataType)
    names = schema.names
    return map_arrow(found, batch, schema)


def _record_schema(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("id", kind),
            T.StructField("text_key", T.LongType()), T.StructField("n_lines", T.IntegerType()), T.StructField("at", T.IntegerType()),
        ]
    )


class _Streamed:
    """One sorted partition. Held over: records of the open hash while fewer than ``least`` documents have it."""

    def __init__(self, least: int, schema: pa.Schema):
        self.least, self.schema = least, schema
        self.hash: tuple[int, int] | None = None
        self.first = True  # the open hash may have begun in the partition before
        self.documents = 0
        self.top = self.last = None
        self.held: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        high, low = (batch.column(k).to_numpy() for k in (0, 1))
        new_hash = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        starts = np.flatnonzero(new_hash)
        ends = np.append(starts[1:], batch.num_rows)
        code = batch.column(2).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ordinal = np.cumsum(new_hash | np.concatenate([[True], code[1:] != code[:-1]]))
        group = np.cumsum(new_hash) - 1
        ordinal -= ordinal[starts][group]  # of a row's document among those of its hash, from 0
        yield from self.feed(batch.slice(0, int(ends[0])), (int(high[0]), int(low[0])), ordinal[: ends[0]])
        if len(starts) > 1:
            inside = (group > 0) & (group < len(starts) - 1) & (ordinal > 0) & (ordinal[ends - 1] + 1 >= self.least)[group]
            yield from self.out(batch.take(pa.array(np.flatnonzero(inside))), _DROPPED)
            k = int(starts[-1])
            yield from self.feed(batch.slice(k), (int(high[k]), int(low[k])), ordinal[k:])

    def feed(self, rows: pa.RecordBatch, own: tuple[int, int], ordinal: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Records of one hash, which may be open since the batch before."""
        identifiers = rows.column(2)
        if self.hash != own:
            if self.hash is not None:
                yield from self.close(False)
                self.first = False
            self.hash, self.documents, self.top, self.held = own, 0, identifiers[0].as_py(), []
        goes_on = self.documents > 0 and identifiers[0].as_py() == self.last
        ordinal = ordinal + self.documents - goes_on
        self.documents, self.last = int(ordinal[-1]) + 1, identifiers[-1].as_py()
        if self.first:
            yield from self.out(rows, _WAITING)
            return
        self.held.append(rows.take(pa.array(np.flatnonzero(ordinal > 0))))
        if self.documents >= self.least:
            for held in self.held:
                yield from self.out(held, _DROPPED)
            self.held = []

    def close(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The open hash has ended in this partition, or (``last``) may go on in the next."""
        if self.hash is None or not (self.first or last):
            return
        for held in self.held:
            yield from self.out(held, _WAITING)
        none = pa.nulls(1)
        counted = [pa.array([self.hash[0]]), pa.array([self.hash[1]]), pa.array([self.top], self.schema.field(2).type), none, none, none]
        yield pa.RecordBatch.from_arrays(
            [c.cast(f.type) for c, f in zip([*counted, pa.array([_COUNT]), pa.array([self.documents])], self.schema)], schema=self.schema
        )

    def out(self, rows: pa.RecordBatch, kind: int) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            extra = [pa.array(np.full(rows.num_rows, kind, np.int8)), pa.nulls(rows.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra], schema=self.schema)


def dropped_lines(records: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The records (of ``line_records``) whose line is dropped: its hash is in enough ids, and its id is not the largest of them.

    A null id is smaller than all others. A line is kept as often as the largest id has it. No records: no rows.
    """
    least = settings.least_documents
    schema = T.StructType([*records.schema.fields, T.StructField("kind", T.ByteType()), T.StructField("documents", T.LongType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                if state is None:
                    state = _Streamed(least, pa.schema([*batch.schema, pa.field("kind", pa.int8()), pa.field("documents", pa.int64())]))
                yield from state.add(batch)
        if state is not None:
            yield from state.close(True)
        give_back()

    ship(records.sparkSession)
    order = [F.col("high"), F.col("low"), F.col("id").desc_nulls_last()]
    # a document's records of one hash meet in one task: the ranges are cut by all three columns
    sorted_rows = records.repartitionByRange(*order).sortWithinPartitions(*order, "at")
    found = stored(sorted_rows.mapInArrow(stream, schema), "lines")
    # two hashes a task at most
    totals = found.where(F.col("kind") == _COUNT).groupBy("high", "low").agg(F.sum("documents").alias("of"), F.max("id").alias("top"))
    waiting = found.where(F.col("kind") == _WAITING).join(F.broadcast(totals.where(F.col("of") >= least)), ["high", "low"])
    late = waiting.where(~F.col("id").eqNullSafe(F.col("top")))
    return found.where(F.col("kind") == _DROPPED).select(records.columns).unionByName(late.select(records.columns))


def keep_bitmaps(documents: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_key, n_lines, n_dropped, bitmap) of each document that loses lines; all others keep all.

    ``bitmap`` is zlib-compressed, one bit per line in order, 1 for kept. ``text_key`` tells rows with one id and different texts
    apart; such rows count as one document. Repeated rows share a bitmap. Null and empty texts have one empty line, never dropped.
    """
    lost = dropped_lines(line_records(documents, settings, id_column, text_column), settings)
    places = lost.groupBy("id", "text_key", "n_lines").agg(F.collect_set("at").alias("places"))

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        made = [_bitmap(n, at) for n, at in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())]
        counts = pc.list_value_length(rows.column(3)).cast(pa.int32())
        return pa.RecordBatch.from_arrays([*rows.columns[:3], counts, pa.array(made, pa.binary())], names=names)

    fields = [*places.schema.fields[:3], T.StructField("n_dropped", T.IntegerType()), T.StructField("bitmap", T.BinaryType())]
    names = [f.name for f in fields]
    return map_arrow(places, batch, T.StructType(fields))


def _bitmap(n: int, dropped: list[int]) -> bytes:
    bits = np.ones(n, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def read_bitmap(bitmap: bytes, n: int) -> np.ndarray:
    """Whether each of ``n`` lines is kept."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def kept_text(documents: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``documents``: id, ``n_lines``, ``n_dropped`` and ``kept``, the lines that stay, joined by newlines.

    The only step that moves texts: each meets its own bitmap. Repeated rows give a row each; other columns are not read.
    """
    texts = _identified(documents, id_column, text_column)
    found = bitmaps.select(F.col("id").alias("of_id"), F.col("text_key").alias("of_key"), "bitmap")
    same = (F.col("text_key") == F.col("of_key")) & F.col("id").eqNullSafe(F.col("of_id"))

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        sizes, dropped, texts = [], [], []
        for text, bitmap in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
            lines = text.split(b"\n")
            sizes.append(len(lines))
            if bitmap is not None:
                lines = [lines[k] for k in np.flatnonzero(read_bitmap(bitmap, len(lines)))]
                text = b"\n".join(lines)
            dropped.append(sizes[-1] - len(lines))
            texts.append(text)
        columns = [rows.column(0), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_column, "n_lines", "n_dropped", "kept"]
    schema = T.StructType(
        [
            T.StructField(id_column, texts.schema["id"].dataType), T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.BinaryType()),
        ]
    )
    met = texts.join(found, same, "left").select("id", "text", "bitmap")
    return map_arrow(met, batch, schema).withColumn("kept", F.col("kept").cast("string"))
