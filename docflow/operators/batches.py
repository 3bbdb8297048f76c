"""Arrow batches for Python passes: bounded in bytes, worked on in slices."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch where the session keeps Spark's default, and of a slice worked on at once.
BATCH_BYTES, SLICE_BYTES, DEFAULT_BYTES = "2m", 2 << 20, 64 << 20


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of about SLICE_BYTES of each batch; a row over it is a part of its own."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_tuples(df: DataFrame, work: Callable[..., Iterable[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """mapInArrow with ``work`` called on the values of each row; it gives the rows that come of it.

    What is in Python objects at once is a slice and its results, however long a partition is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if conf.get(key).rstrip("b") == str(DEFAULT_BYTES):
        conf.set(key, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [out for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for out in work(*row)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
