"""Arrow helpers for the operators that run in Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docflow.operators import batches as core


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them to str."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def by_bytes(items: list, size: Callable[[object], int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges [i, j) of at most ``limit`` bytes together; an item over it goes alone."""
    start, held = 0, 0
    for k, item in enumerate(items):
        n = size(item)
        if k > start and held + n > limit:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(items):
        yield start, len(items)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches to two megabytes unless the session has set its own bound.

    A batch is held by the JVM and the Python worker at once; long texts would make it large.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(core.DEFAULT_BYTES):
        spark.conf.set(key, core.BATCH_BYTES)


def release() -> None:
    """Give freed memory back to the system; idle workers would keep it for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of bounded size of each batch; memory is given back at the end of a partition."""
    try:
        yield from core.slices(batches)
    finally:
        release()


def map_rows(df: DataFrame, columns: list[str], schema: str, work: Callable[[pa.RecordBatch], dict[str, list]], arrow_schema: pa.Schema) -> DataFrame:
    """mapInArrow over the named columns only; ``work`` returns the output columns of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict(work(part), schema=arrow_schema)

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)
