"""Stored intermediate tables, joins that spread hot keys, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.session import scratch_path

SALTS = 8


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors cost no earlier step."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(rows: DataFrame, facts: DataFrame, on: list[str], spread_by: list[str], salts: int = SALTS) -> DataFrame:
    """``rows`` inner-joined to ``facts`` (few per key), each key's rows dealt over ``salts`` tasks."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"]).drop("_salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node, as ``component``, for each ``node`` that has a link.

    Each round takes the least label among a node's neighbours, then that label's own label;
    rounds grow with the logarithm of a chain's length. Nothing is gathered on the driver but
    the number of labels that changed.
    """
    ends = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v"))
                  .union(links.select(F.col(b).alias("u"), F.col(a).alias("v"))), "links")
    label = stored(ends.groupBy(F.col("v").alias("node")).agg(F.least(F.min("u"), F.col("node")).alias("component")), "labels")
    while True:
        near = ends.join(label.select(F.col("node").alias("u"), "component"), "u").select(
            F.col("v").alias("node"), F.col("component").alias("c"), F.lit(None).cast("boolean").alias("own"))
        own = label.select("node", F.col("component").alias("c"), F.lit(True).alias("own"))
        step = stored(near.union(own).groupBy("node").agg(
            F.min("c").alias("c"), F.max(F.when(F.col("own"), F.col("c"))).alias("was")), "labels")
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("further"))
        nxt = stored(step.join(jump, "c", "left").select(
            "node", F.least("c", F.coalesce("further", "c")).alias("component"), "was"), "labels")
        label = nxt.select("node", "component")
        if nxt.where(F.col("component") != F.col("was")).limit(1).count() == 0:
            return label
