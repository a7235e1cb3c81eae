"""Bring your own model or row function, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def batch_score(df: DataFrame, make_predict_fn: Callable, inputs: list[str], out: str = "score",
                return_type: T.DataType = T.DoubleType(), batch_size: int = 256,
                input_tensor_shapes: list | None = None) -> DataFrame:
    """Adds a model's score. ``make_predict_fn`` loads the model once per Python worker
    and returns the function that scores a batch of numpy inputs."""
    scorer = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size,
                               input_tensor_shapes=input_tensor_shapes)
    return df.withColumn(out, scorer(*[F.col(c) for c in inputs]))


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType | str,
             remove_columns: list[str] | None = None) -> DataFrame:
    """A row function for what expressions cannot say: its result updates the row.

    ``schema`` is that of the columns left after ``remove_columns`` and the update.
    """
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    drop, target = set(remove_columns or []), to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{**{k: v for k, v in row.items() if k not in drop}, **fn(row)} for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, target)

    return df.mapInArrow(run, kinds)
