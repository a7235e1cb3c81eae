"""Arrow helpers that the document operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Rows of one Arrow batch. Documents are a few kilobytes, so a batch stays at some megabytes;
# a single very long document is a batch's size of its own.
BATCH_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session set to hand :data:`BATCH_ROWS` rows to Python at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply a function on record batches; ``make`` builds it once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return small_batches(df).mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a binary column, null as the empty string."""
    return [v or b"" for v in column.to_pylist()]


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
