"""Binary radio and LoRa packets, decoded batch by batch with NumPy record types."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.scalar import lora_source

# Wire layouts, little-endian (fixed values).
RADIO_V1 = np.dtype(
    [
        ("channel", "<i4"),
        ("temp_a", "<f4"),
        ("temp_b", "<f4"),
        ("humi", "<f4"),
        ("volt", "<f4"),
        ("version", "<i4"),
        ("caps", "<u2"),
        ("pad", "<u2"),
        ("nColor", "<i4"),
        ("nLux", "<i4"),
        ("nRed", "<i4"),
        ("nGreen", "<i4"),
        ("nBlue", "<i4"),
        ("nClear", "<i4"),
    ]
)
RADIO_V0 = np.dtype(
    [("channel", "<i4"), ("temp_a", "<f4"), ("temp_b", "<f4"), ("humi", "<f4"), ("volt", "<f4")]
)
LORA = np.dtype([("source_code", "<i4"), ("channel", "<i4"), ("value", "<i4")])

_SPARK_TYPES = {"<i4": T.IntegerType(), "<f4": T.FloatType(), "<u2": T.IntegerType()}
_ARROW_TYPES = {"<i4": pa.int32(), "<f4": pa.float32(), "<u2": pa.int32()}


def _members(layout: np.dtype) -> dict[str, str]:
    return {name: layout[name].str for name in layout.names if name != "pad"}


def _unpack(payload: pa.Array, layout: np.dtype) -> np.ndarray:
    """Records of one layout, read in place from the bytes of a column whose values all have its size."""
    packed = payload.cast(pa.binary(layout.itemsize))
    start = packed.offset * layout.itemsize
    return np.frombuffer(packed.buffers()[1], dtype=layout, count=len(packed), offset=start)


def decode(df: DataFrame, payload: str, layouts: list[np.dtype], defaults: dict[str, int] | None = None) -> DataFrame:
    """Replace a BINARY column by the members of the layout that has its length.

    Members a layout lacks are NULL, or take the given default. Payloads of any other length are not decoded, see
    ``undecodable``.
    """
    defaults = defaults or {}
    members = {name: kind for layout in layouts for name, kind in _members(layout).items()}
    others = [f for f in df.schema.fields if f.name != payload]
    schema = T.StructType([*others, *[T.StructField(n, _SPARK_TYPES[k]) for n, k in members.items()]])
    names = [f.name for f in others]

    def columns(batch: pa.RecordBatch, layout: np.dtype) -> pa.RecordBatch:
        records = _unpack(batch.column(payload), layout)
        decoded = []
        for name, kind in members.items():
            if name in layout.names:
                decoded.append(pa.array(np.ascontiguousarray(records[name]).astype(kind if kind != "<u2" else "<i4")))
            else:
                fallback = pa.scalar(defaults.get(name), type=_ARROW_TYPES[kind])
                decoded.append(pa.repeat(fallback, len(records)))
        kept = [batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays([*kept, *decoded], names=[*names, *members])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            size = pc.binary_length(batch.column(payload))
            for layout in layouts:
                part = batch.filter(pc.equal(size, layout.itemsize))
                if part.num_rows:
                    yield columns(part, layout)

    sizes = [layout.itemsize for layout in layouts]
    return df.where(F.length(payload).isin(sizes)).mapInArrow(batches, schema)


def undecodable(df: DataFrame, payload: str, layouts: list[np.dtype]) -> DataFrame:
    """The packets no layout fits."""
    sizes = [layout.itemsize for layout in layouts]
    return df.where(F.col(payload).isNull() | ~F.length(payload).isin(sizes))


def decode_packets(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Radio packets of both versions; version 0 carries neither capabilities nor colours."""
    return decode(df, payload, [RADIO_V1, RADIO_V0], defaults={"version": 0})


def decode_lora(df: DataFrame, payload: str = "payload") -> DataFrame:
    return decode(df, payload, [LORA]).withColumn("source", lora_source(F.col("source_code")))


def encode(df: DataFrame, layout: np.dtype, payload: str = "payload") -> DataFrame:
    """Pack the members of a layout into one BINARY column; NULL members are written as zero."""
    members = _members(layout)
    others = [f for f in df.schema.fields if f.name not in members]
    schema = T.StructType([*others, T.StructField(payload, T.BinaryType())])
    names = [f.name for f in others]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            records = np.zeros(batch.num_rows, dtype=layout)
            for name, kind in members.items():
                filled = pc.fill_null(batch.column(name), 0)
                records[name] = filled.to_numpy(zero_copy_only=False).astype(kind)
            buffers = [None, pa.py_buffer(records.tobytes())]
            packed = pa.Array.from_buffers(pa.binary(layout.itemsize), batch.num_rows, buffers)
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, packed.cast(pa.binary())], names=[*names, payload])

    return df.mapInArrow(batches, schema)
