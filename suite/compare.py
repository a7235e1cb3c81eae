"""Run registered queries beside their SQL and report the first difference."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import SparkSession

from suite.oracle import ORACLE
from suite.queries import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def _differs(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return not (a == b or (math.isnan(a) and math.isnan(b)))
    return type(a) is not type(b) or a != b


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf: str) -> str | None:
    """None when columns, rows and values agree, else what does not."""
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=_sort_key)
    answer = con.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    if sorted(names) != columns:
        return f"columns {columns} but SQL has {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=_sort_key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows but SQL has {len(theirs)}"
    wrong = [(m, t) for m, t in zip(mine, theirs) if any(_differs(a, b) for a, b in zip(m, t))]
    return f"{len(wrong)} rows differ, first {columns}: {wrong[0]}" if wrong else None
