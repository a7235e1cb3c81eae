"""Flat metric tables and their sort orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the short and long table, and the keys each sorts by.
SHORT = ["model_name", "model_path", "perplexity", "test_loss", "training_time_hours", "total_steps"]
LONG = ["model_name", "model_path", "preference_accuracy", "loss_margin", "perplexity", "test_loss",
        "training_time_hours", "total_steps", "best_eval_loss", "final_eval_loss"]
TABLES = {
    "a": (SHORT, ["perplexity", "test_loss"]),
    "b": (LONG, ["preference_accuracy", "loss_margin"]),
}


def flatten(results: DataFrame, columns: list[str]) -> DataFrame:
    """``run`` as the model name and the listed metrics; an absent metric is null."""
    have = set(results.columns)
    numbers = {"total_steps": "bigint", "model_path": "string"}
    return results.select(
        F.col("run").alias("model_name"),
        *[F.col(c) if c in have else F.lit(None).cast(numbers.get(c, "double")).alias(c)
          for c in columns if c != "model_name"])


def leaderboard(results: DataFrame, kind: str = "a") -> DataFrame:
    """Table ``a`` (perplexity, test loss) or ``b`` (accuracy, margin), largest first, nulls last.

    ``a_best_first`` turns the keys of ``a`` round, so that the lowest perplexity leads.
    Keys the results do not hold are skipped; the name breaks ties.
    """
    ascending = kind == "a_best_first"
    columns, keys = TABLES["a" if ascending else kind]
    order = F.asc_nulls_last if ascending else F.desc_nulls_last
    used = [order(k) for k in keys if k in results.columns]
    return flatten(results, columns).orderBy(*used, "model_name")


def samples_of(results: DataFrame, run: str) -> DataFrame:
    """One run's generation samples; an empty list when it has none."""
    empty = F.array().cast("array<struct<prompt string, response string>>")
    return results.where(F.col("run") == run).select(
        "run", F.coalesce("generation_samples", empty).alias("generation_samples"))
