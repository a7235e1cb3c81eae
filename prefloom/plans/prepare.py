"""A preference table to one method's training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from prefloom.operators import sample
from prefloom.plans import registry
from prefloom.sources import readers


def prepare(method: str, df: DataFrame, key: list[str], limit: int | None = None, seed: int = 42) -> DataFrame:
    """Check the contract, project, and take the first ``limit`` rows.

    Rows are taken in ``key`` order; a shuffled method takes them after its projection
    and seeded shuffle, so the limit counts projected rows. ``key`` columns are kept.
    """
    spec = registry.method(method)
    spec.check(df)
    rows = spec.project(df, key)
    if not spec.shuffled:
        return sample.take_first(rows, limit, key)
    order = [*key, "label"] if "label" in rows.columns else key
    if limit:
        return sample.take_first(rows, limit, order, seed)
    return sample.seeded_shuffle(rows, order, seed)


def prepare_splits(method: str, df: DataFrame, key: list[str], split: str, eval_split: str | None = None,
                   max_train: int | None = None, max_eval: int | None = None,
                   column: str = "split") -> tuple[DataFrame, DataFrame | None]:
    """Training and evaluation rows, both projected the same way, each with its own limit."""
    train, held_out = readers.read_splits(df, split, eval_split, column)
    return (prepare(method, train, key, max_train),
            None if held_out is None else prepare(method, held_out, key, max_eval))


def prepare_path(spark: SparkSession, method: str, source: str, key: list[str], split: str | None = "train",
                 eval_split: str | None = None, max_train: int | None = None, max_eval: int | None = None,
                 column: str = "split", schema: T.StructType | str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Training and evaluation rows from a file, a folder with nested ``split=`` folders, or a table's name.

    Only the files of the splits asked for are read. Rows without a ``column`` of splits are all
    training rows; asking for an evaluation split of such a source is an error.
    """
    if readers.path_exists(spark, source):
        df = readers.read_folder(spark, source, schema)
    elif "/" not in source and spark.catalog.tableExists(source):
        df = spark.table(source)
    else:
        raise FileNotFoundError(f"neither a path nor a table: {source}")
    if split is not None and column in df.columns:
        return prepare_splits(method, df, key, split, eval_split, max_train, max_eval, column)
    if eval_split is not None:
        raise ValueError(f"{source} has no column {column!r}")
    return prepare(method, df, key, max_train), None
