"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.session import ship, work_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """One batch out for each batch in; batches hold a bounded number of bytes (see ``session.ship``)."""
    ship(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch)
            if made is not None and made.num_rows:
                yield made
        give_back()

    return df.mapInArrow(each, schema)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: idle workers live on beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, kept when executors are lost."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(identifier: Column, folds: int) -> Column:
    """crc32 of an id written as text, modulo the folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(identifier.cast("string")) % folds, F.lit(0))


def bounded_sample(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``: the same ones on every run."""
    name = f"order_{uuid.uuid4().hex[:8]}"
    return df.withColumn(name, F.xxhash64(key)).orderBy(name).limit(rows).drop(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
