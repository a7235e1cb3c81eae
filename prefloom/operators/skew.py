"""Equi-join that spreads hot keys, for sides where one key may hold much of the data.

Hot keys are found by a heavy-hitters sketch of the keys' hashes: each task keeps a sketch of a fixed
size, lanes of tasks are merged, then the lanes. A key with HOT_ROWS rows or more is dealt over one salt for
every HOT_ROWS of its rows, whatever its share of all rows, as long as the sketch can tell it from the
rest, which it does for any key with more than about one in TRACKED of all rows. No
more than TRACKED keys are listed, and only that list, of hashes and salts, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
TRACKED = 100_000
LANES = 64
# Rows under a null key match nothing and need no copies of the other side, so they spread freely.
NULL_SALTS = 1 << 20


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``_key, _salts``: the hashes of hot keys of ``df`` and the number of salts each needs."""
    lanes = df.select(F.xxhash64(*on).alias("key"), F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane"))
    # Lanes are merged as one group, since without a group a task that has none fails.
    merged = lanes.groupBy("lane").agg(F.expr(f"approx_top_k_accumulate(key, {TRACKED})").alias("s")).groupBy(F.lit(True)).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {TRACKED}), {TRACKED})").alias("top"))
    return _salts(merged.select(F.inline("top")).select(F.col("item").alias("_key"), F.col("count").alias("_n")), hot_rows)


def known_hot(counted: DataFrame, on: list[str], weight: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As :func:`hot_keys`, of a frame that holds the rows of each key in the column ``weight``."""
    many = counted.where(F.col(weight) >= hot_rows).groupBy(F.xxhash64(*on).alias("_key")).agg(F.max(weight).alias("_n"))
    return _salts(many.orderBy(F.desc("_n")).limit(TRACKED), hot_rows)


def _salts(counted: DataFrame, hot_rows: int) -> DataFrame:
    hot = counted.where(F.col("_key").isNotNull() & (F.col("_n") >= hot_rows))
    return hot.select("_key", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str],
                how: str = "left", hot_rows: int = HOT_ROWS,
                hot_from: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """``left`` joined to ``right`` on equal keys, with the hot keys of ``left`` salted.

    ``spread_by`` names the columns of ``left`` that tell its rows apart. Rows of
    ``left`` under a hot key (or a null one, which matches nothing) are dealt over
    the key's salts; the matching rows of ``right`` are repeated once per salt.
    Results equal those of the plain join. ``how`` is ``inner`` or ``left``.

    Hot keys are sketched on ``left``, or on ``hot_from`` where a cheaper frame has them: ``left``
    before an earlier join, or, with ``weight``, a frame of one row per key whose ``weight`` is
    no lower than the rows ``left`` has. Without ``hot_from``, ``weight`` names a positive column
    of ``left`` that the join uses anyway; reading it too lets Spark reuse the shuffle below. All of
    this steers the layout only, never the result.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"salted_join supports inner and left joins, not {how!r}")
    if hot_from is not None and weight is not None:
        hot = known_hot(hot_from, on, weight, hot_rows)
    else:
        source = left if hot_from is None else hot_from
        hot = hot_keys(source if weight is None else source.where(F.col(weight) > 0), on, hot_rows)
    hot = F.broadcast(hot)
    no_match = F.lit(False)
    for key in on:
        no_match = no_match | F.col(key).isNull()
    salts = F.when(no_match, F.lit(NULL_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    marked = lambda df: df.withColumn("_key", F.xxhash64(*on)).join(hot, "_key", "left").drop("_key")
    spread = marked(left).withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    repeated = marked(right).withColumn("_salt", F.explode(copies)).drop("_salts")
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")
