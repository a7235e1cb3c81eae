"""Seeded order, first-N samples and the two kinds of evaluation cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.session import stored

# Rows that a sort with a limit keeps in per-task heaps; what comes before them is found by counting.
HEAP_ROWS = 10_000
PIVOTS = 64


def seeded_key(key: list[str], seed: int = 42) -> Column:
    """Position key of the seeded shuffle; depends on the row's key only, not its partition."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def seeded_shuffle(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """The same permutation whatever the partitioning; ``key`` must tell rows apart."""
    return df.orderBy(seeded_key(key, seed), *key)


def seeded_order(df: DataFrame, key: list[str], seed: int = 42, column: str = "position") -> DataFrame:
    """``df`` with each row's place in the seeded shuffle, counted from 0.

    Rows are sorted into slices once and stored; a row's place is the rows of the slices before its own,
    a running sum over one count per slice, and its place within the slice.
    """
    if column in df.columns:
        raise ValueError(f"rename this column first: {column}")
    bits = 33  # of a row's number within its partition
    numbered = stored(seeded_shuffle(df, key, seed).withColumn(column, F.monotonically_increasing_id()), "shuffled")
    slice_of = F.shiftright(column, bits)
    counts = numbered.groupBy(slice_of.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per slice.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    placed = numbered.withColumn("_slice", slice_of).join(F.broadcast(starts), "_slice")
    return placed.withColumn(column, F.col("_start") + within).select(*df.columns, column)


def take_first(df: DataFrame, n: int | None, key: list[str], seed: int | None = None,
               top_rows: int = HEAP_ROWS) -> DataFrame:
    """The first ``n`` rows by ``key``, or by the seeded shuffle of it; 0 or None takes all.

    ``key`` must tell rows apart and be orderable; nulls come first. While more than ``top_rows`` are
    wanted, rows are counted between sampled keys, and those before the stretch that holds the cut
    are in; the rest come from per-task heaps. Nothing is sorted whole, and counting reads keys only.
    """
    if not n or n <= 0:
        return df
    order = F.struct(*([seeded_key(key, seed).alias("_seeded")] if seed is not None else []), *key)
    keys, low, high = df.select(order.alias("_o")), None, None
    while n > top_rows:
        inside = F.lit(True) if low is None else F.col("_o") > low
        if high is not None:
            inside = inside & (F.col("_o") <= high)
        here = keys.where(inside)
        pivots = here.orderBy(F.xxhash64("_o"), "_o").limit(PIVOTS).distinct().orderBy("_o").collect()
        table = df.sparkSession.createDataFrame(pivots, here.schema)
        listed = table.agg(F.array_sort(F.collect_list("_o"))).scalar()
        below = F.size(F.filter("_p", lambda p: p < F.col("_o")))
        # At most one count per pivot and one more.
        rows = dict(here.withColumn("_p", listed).select(below.alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect())
        if sum(rows.values()) < n:
            return df
        at = lambda i: df.sparkSession.createDataFrame([pivots[i]], here.schema).select("_o").scalar()
        b = 0
        while rows.get(b, 0) < n:
            n -= rows.get(b, 0)
            b += 1
        low, high = at(b - 1) if b else low, at(b) if b < len(pivots) else high
    if low is None:
        return df.orderBy(order).limit(n)
    return df.where(order <= low).unionByName(df.where(order > low).orderBy(order).limit(n))


def cap_by_position(df: DataFrame, n: int | None, key: list[str], keep: Column) -> DataFrame:
    """Stop at row ``n``: rows that fail ``keep`` still use up a position."""
    return take_first(df, n, key).where(keep)


def cap_by_valid(df: DataFrame, n: int | None, key: list[str], keep: Column) -> DataFrame:
    """Stop after ``n`` rows that pass ``keep``."""
    return take_first(df.where(keep), n, key)


def message_source(df: DataFrame) -> str | None:
    """Column to score: messages, else chosen, else none."""
    return next((c for c in ("messages", "chosen") if c in df.columns), None)
