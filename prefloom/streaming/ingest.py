"""JSON-line files arriving in a folder, to canonical records.

Parsing and classifying look at one row at a time, so the batch functions apply
unchanged and hold no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from prefloom.operators import records


def stream_records(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records of every line of every file that appears below ``path``."""
    lines = spark.readStream.text(path).withColumnRenamed("value", "text")
    return records.canonical(records.classify(records.json_items(lines)))


def write_stream(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet, each input file once; ``once`` stops when what is there is done."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(out)
