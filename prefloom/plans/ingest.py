"""JSON texts to canonical training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefloom.operators import records
from prefloom.session import configure
from prefloom.sources import readers, sinks


def ingest(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Canonical records, and the count of rejected items by reason."""
    classified = records.classify(records.json_items(texts, text))
    return records.canonical(classified), records.reject_counts(classified)


def ingest_path(spark: SparkSession, path: str, out: str, layout: str = "value") -> tuple[DataFrame, DataFrame]:
    """Read JSON texts below ``path`` and publish the records at ``out``: records, and rejects by reason.

    Records are written as a new version of ``out``, which readers see (:func:`sinks.read_published`)
    only once it is complete and holds any; when nothing was recognised this fails and what was there
    stays, as it does when the run breaks off. ``out`` must not lie below ``path``.
    """
    configure(spark)
    if f"{out.rstrip('/')}/".startswith(f"{path.rstrip('/')}/"):
        raise ValueError(f"{out} lies below {path}")
    accepted, rejects = ingest(readers.read_texts(spark, path, layout))
    fresh = sinks.new_version(out)
    sinks.write_records(accepted, fresh)
    if spark.read.parquet(fresh).isEmpty():
        sinks.remove(spark, fresh)
        raise ValueError(f"no valid training record in {path}")
    sinks.commit(spark, out, fresh)
    return sinks.read_published(spark, out), rejects
