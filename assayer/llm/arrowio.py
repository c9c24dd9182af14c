"""Arrow batches of bounded size between Spark and numpy."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of one text column that a Python worker holds at once (one longer text is handled alone).
SLICE_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes as well as rows; a smaller limit of the session stays, Spark's own is eight times as large."""
    now = int(re.match(r"\d+", spark.conf.get(BATCH_SETTING))[0])
    if now > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` of each part stays near ``limit`` bytes."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, size in enumerate(sizes):
            if held + size > limit and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts with null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def give_back() -> None:
    """Free memory of finished work goes back to the system, where the worker would keep it for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def collector_off() -> Iterator[None]:
    """Without Python's search for cycles, for work that makes many objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def map_slices(df: DataFrame, column: str, fn, schema: str, out: pa.Schema, limit: int = SLICE_BYTES) -> DataFrame:
    """``fn(batch) -> columns`` over slices of a frame with at most ``limit`` bytes of ``column``, without a shuffle."""
    bound_batches(df.sparkSession)

    def run(batches):
        for part in slices(batches, column, limit):
            yield rows(out, *fn(part))
        give_back()

    return df.mapInArrow(run, schema)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)
