"""Metrics per run: training log, loss and perplexity, preference accuracy, and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions import text as X


def log_rows(states: DataFrame) -> DataFrame:
    """Trainer states ``(run, global_step, best_model_checkpoint, log_history)`` as one row per entry.

    States in slices have ``first`` too, the number of a slice's first entry.
    """
    first = F.col("first") if "first" in states.columns else F.lit(0)
    return states.select("run", first.alias("first"), F.posexplode("log_history").alias("pos", "entry")).select(
        "run", (F.col("first") + F.col("pos")).alias("pos"), *[F.col(f"entry.{c}").alias(c) for c in ("loss", "eval_loss", "train_runtime")])


def training_metrics(logs: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Loss milestones and run facts per run.

    ``logs`` holds ``run, pos, loss, eval_loss, train_runtime``. Entries with a loss and
    no eval loss give the first and last training loss; entries with an eval loss give
    its best and last. The run time counts only when the last entry holds it, else 0.
    ``states`` (``run, global_step, best_model_checkpoint``, and ``first`` if in slices) adds steps and checkpoint.
    """
    rolled = logs.groupBy("run").agg(*_log_figures())
    if states is not None:
        facts = (states.where("first = 0") if "first" in states.columns else states).select(
            "run", F.coalesce("global_step", F.lit(0)).cast("bigint").alias("total_steps"),
            F.col("best_model_checkpoint").alias("best_checkpoint"))
        rolled = facts.join(rolled, "run", "left").withColumn(
            "training_time_seconds", F.coalesce("training_time_seconds", F.lit(0.0)))
    return rolled.withColumn("training_time_hours", X.hours(F.col("training_time_seconds")))


def _log_figures() -> list[Column]:
    """Loss milestones and run time of a group of log entries."""
    train = F.when(F.col("loss").isNotNull() & F.col("eval_loss").isNull(), F.col("pos"))
    evaluated = F.when(F.col("eval_loss").isNotNull(), F.col("pos"))
    return [
        F.min_by("loss", train).alias("initial_train_loss"),
        F.max_by("loss", train).alias("final_train_loss"),
        F.min("eval_loss").alias("best_eval_loss"),
        F.max_by("eval_loss", evaluated).alias("final_eval_loss"),
        F.max_by(F.coalesce("train_runtime", F.lit(0.0)), "pos").alias("training_time_seconds")]


def training_by_group(logs: DataFrame, by: str) -> DataFrame:
    """Loss milestones per run, per run and ``by``, and of all entries, in one pass.

    ``grouping`` tells the rows apart: 0 for run and ``by``, 1 for a run, 3 for all; columns that a
    row sums over are null. ``pos`` orders the entries of all runs.
    """
    sets = logs.groupingSets([["run", by], ["run"], []], "run", by)
    return sets.agg(F.grouping_id().cast("int").alias("grouping"), F.count(F.lit(1)).alias("entries"), *_log_figures())


def preference_by_group(losses: DataFrame, by: str) -> DataFrame:
    """Preference metrics per run, per run and ``by``, and of all pairs, as :func:`training_by_group`."""
    right = F.col("chosen_loss") < F.col("rejected_loss")
    return losses.groupingSets([["run", by], ["run"], []], "run", by).agg(
        F.grouping_id().cast("int").alias("grouping"), F.count_if(right).alias("preference_correct"),
        F.count(F.lit(1)).alias("preference_total"), F.avg(right.cast("double")).alias("preference_accuracy"),
        (F.avg("rejected_loss") - F.avg("chosen_loss")).alias("loss_margin"))


def loss_metrics(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Token-weighted loss and its perplexity per run; no tokens gives 0 and 1."""
    by = by or ["run"]
    rolled = losses.groupBy(*by).agg(
        F.sum(F.col("loss") * F.col("num_tokens")).alias("_weighted"),
        F.sum("num_tokens").alias("num_tokens"))
    loss = F.when(F.col("num_tokens") > 0, F.col("_weighted") / F.col("num_tokens")).otherwise(0.0)
    return rolled.select(*by, loss.alias("test_loss"), X.perplexity(loss).alias("perplexity"), "num_tokens")


def preference_metrics(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy (chosen strictly below rejected), mean losses and margin per run.

    A run without scored pairs has no row.
    """
    by = by or ["run"]
    right = F.col("chosen_loss") < F.col("rejected_loss")
    rolled = losses.groupBy(*by).agg(
        F.count_if(right).alias("preference_correct"),
        F.count(F.lit(1)).alias("preference_total"),
        F.avg("chosen_loss").alias("avg_chosen_loss"),
        F.avg("rejected_loss").alias("avg_rejected_loss"))
    return rolled.select(
        *by, (F.col("preference_correct") / F.col("preference_total")).alias("preference_accuracy"),
        "preference_correct", "preference_total", "avg_chosen_loss", "avg_rejected_loss",
        (F.col("avg_rejected_loss") - F.col("avg_chosen_loss")).alias("loss_margin"))


def merge_metrics(runs: DataFrame, *parts: DataFrame) -> DataFrame:
    """All metrics beside each run; a later part's value wins over an earlier one.

    Every part has one row per run, so no key of these joins is hot.
    """

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns and c != "run"]
        renamed = right.withColumnsRenamed({c: f"_new_{c}" for c in shared})
        joined = left.join(renamed, "run", "left")
        return joined.select([
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in shared else F.col(c)
            for c in left.columns] + [F.col(c) for c in right.columns if c != "run" and c not in shared])

    return reduce(add, parts, runs)


def nest_samples(samples: DataFrame, n: int) -> DataFrame:
    """``(run, pos, prompt, response)`` to one row per run with its first ``n`` samples in order.

    ``pos`` counts from 0 within the run, so no more than ``n`` rows are ever gathered.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", "prompt", "response")))
    return samples.where(F.col("pos") < n).groupBy("run").agg(F.transform(
        listed, lambda s: F.struct(s["prompt"].alias("prompt"), s["response"].alias("response"))
    ).alias("generation_samples"))


def summary_lines(results: DataFrame) -> DataFrame:
    """Shown figures per run, in name order; null and 0 show as N/A."""

    def shown(name: str, pattern: str, value: Column) -> Column:
        return X.number_or_na(value, pattern).alias(name)

    return results.select(
        "run", shown("val_loss", "%.4f", F.col("best_eval_loss")),
        shown("perplexity", "%.2f", F.col("perplexity")),
        shown("preference_accuracy", "%.2f%%", F.col("preference_accuracy") * 100)).orderBy("run")
