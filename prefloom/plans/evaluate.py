"""Runs, test samples and pairs to one row of metrics per run."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions import text as X
from prefloom.operators import catalog, metrics, ngram, sample
from prefloom.plans import registry
from prefloom.session import stored
from prefloom.sources import readers, sinks

# Why a test row or a pair is not scored.
NO_TEXT, BROKEN, EMPTY_SIDE = "no_text", "broken_message", "empty_side"


def test_texts(df: DataFrame, key: list[str], max_samples: int | None = None) -> DataFrame | None:
    """Texts to score from messages or chosen; skipped rows use up a position of the cap.

    :func:`test_rejects` gives the rows that are skipped.
    """
    source = sample.message_source(df)
    if source is None:
        return None
    return sample.cap_by_position(df, max_samples, key, F.col(source).isNotNull()).select(
        *key, _strict(df, source).alias("text")).where(F.col("text").isNotNull())


def valid_pairs(df: DataFrame, key: list[str], max_samples: int | None = None) -> DataFrame:
    """Pairs with both sides non-empty; skipped rows do not use up the cap."""
    return sample.cap_by_valid(df, max_samples, key, both_sides(df))


def both_sides(df: DataFrame) -> Column:
    return (X.not_empty(F.col("chosen"), df.schema["chosen"].dataType)
            & X.not_empty(F.col("rejected"), df.schema["rejected"].dataType))


def _strict(df: DataFrame, column: str) -> Column:
    """Text of a column of texts or message lists, null where a message lacks a part."""
    text = F.col(column)
    return X.format_messages_strict(text) if df.schema[column].dataType.typeName() == "array" else text


def test_rejects(df: DataFrame, key: list[str]) -> DataFrame:
    """``key, reject_reason`` of the test rows that are not scored: without a text, or with a broken message."""
    source = sample.message_source(df)
    if source is None:
        return df.select(*key, F.lit(NO_TEXT).alias("reject_reason"))
    reason = F.when(F.col(source).isNull(), NO_TEXT).when(_strict(df, source).isNull(), BROKEN)
    return df.select(*key, reason.alias("reject_reason")).where(F.col("reject_reason").isNotNull())


def pair_rejects(df: DataFrame, key: list[str]) -> DataFrame:
    """``key, reject_reason`` of the pairs that are not scored: a side is empty, or has a broken message."""
    broken = _strict(df, "chosen").isNull() | _strict(df, "rejected").isNull()
    reason = F.when(~both_sides(df), EMPTY_SIDE).when(broken, BROKEN)
    return df.select(*key, reason.alias("reject_reason")).where(F.col("reject_reason").isNotNull())


def reject_counts(test: DataFrame | None = None, prefs: DataFrame | None = None) -> DataFrame:
    """How many of all test rows and pairs an evaluation leaves out: ``part, reject_reason, n``.

    Rows beyond a cap of the evaluation count too. A part without rejects has no row.
    """
    if test is None and prefs is None:
        raise ValueError("give test rows, pairs or both")
    parts = [make(df, [F.lit(part).alias("part")]) for part, make, df in (
        ("test", test_rejects, test), ("pairs", pair_rejects, prefs)) if df is not None]
    return _all(parts).groupBy("part", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def evaluate(runs: DataFrame, key: list[str], model: ngram.NgramModel | ngram.MixedModel | None = None,
             test: DataFrame | None = None, prefs: DataFrame | None = None,
             logs: DataFrame | None = None, states: DataFrame | None = None,
             samples: DataFrame | None = None, max_samples: int | None = None,
             max_tokens: int | None = None, max_generation_samples: int | None = None,
             extra: dict[str, DataFrame] | None = None, base: ngram.NgramModel | None = None,
             alpha: float = 0.5) -> DataFrame:
    """All metrics of all runs in one plan, over pairs that are stored first; each part is left out when its input is.

    ``runs`` holds ``run`` and any facts to carry. ``max_samples`` caps test rows by
    position and pairs by validity; None scores everything. ``extra`` maps names of
    registered metrics to the frames they roll up. With ``base``, runs whose ``load_as``
    is ``lora`` are scored laid over it with weight ``alpha``, all others by themselves.
    """
    parts = []
    if logs is not None:
        parts.append(metrics.training_metrics(logs, states))
    models = _models(runs, model, base, alpha)
    if models and test is not None:
        texts = test_texts(test, key, max_samples)
        if texts is not None:
            parts.append(_all(_test_loss(texts, m, key, max_tokens) for m in models))
    if models and prefs is not None:
        # Every model reads the pairs more than once; their texts are made once.
        pairs = stored(ngram.pair_texts(valid_pairs(prefs, key, max_samples), key), "pairs")
        parts.append(_all(ngram.preference_rollup(pairs, m, key, max_tokens=max_tokens) for m in models))
    if samples is not None:
        if max_generation_samples is None:
            raise ValueError("say how many generation samples a run keeps")
        parts.append(metrics.nest_samples(samples, max_generation_samples))
    parts += [registry.METRICS[name](frame) for name, frame in (extra or {}).items()]
    return metrics.merge_metrics(runs, *parts)


def evaluate_runs(spark: SparkSession, runs_dir: str, out: str, key: list[str], model: ngram.NgramModel,
                  base: ngram.NgramModel | None = None, methods: list[str] | None = None, base_model: str = catalog.DEFAULT_BASE,
                  order: str = "numeric", **parts) -> DataFrame | None:
    """All runs of a folder to a published result file: one row of metrics per run, as read back.

    Runs are the folders below ``runs_dir`` that hold an adapter or a model; ``methods`` keeps those
    whose names contain one. Training figures come from each run's trainer state, and the
    scorer is chosen per run: one with an adapter config is laid over ``base``, others stand
    alone. ``parts`` are test rows, pairs, samples, caps and weight of :func:`evaluate`. Results are one JSON
    object keyed by run, a new version of ``out``. A folder without runs gives None and leaves ``out``.
    """
    files = readers.run_files(spark, runs_dir)
    found = catalog.with_base(catalog.filter_runs(catalog.run_inventory(files), methods), base_model)
    folder = runs_dir.rstrip("/")
    runs = stored(found.select("run", X.base_name(F.col("run")).alias("model_name"),
                               F.concat(F.lit(f"{folder}/"), "run").alias("model_path"), "load_as"), "runs")
    if runs.isEmpty():
        return None
    # Not stored: Spark's reader takes thousands of rows of slices, and so a large state's whole log, at once.
    states = readers.trainer_states(spark, runs_dir, order, files.join(runs.select("run"), "run", "left_semi"))
    table = stored(evaluate(runs, key, model, base=base, logs=metrics.log_rows(states), states=states, **parts), "evaluated")
    version = sinks.new_version(out)
    sinks.write_results(table, version, "object")
    sinks.commit(spark, out, version)
    back, message = readers.read_results(spark, sinks.published(spark, out), "object")
    if back is None:
        raise OSError(message)
    return back


def _models(runs: DataFrame, model, base: ngram.NgramModel | None, alpha: float) -> list:
    """The models that between them score every run once."""
    if model is None or base is None:
        return [] if model is None else [model]
    overlay = F.coalesce(F.col("load_as") == "lora", F.lit(False))
    return [model.only(runs.where(~overlay)), ngram.MixedModel(base, model.only(runs.where(overlay)), alpha)]


def _all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _test_loss(texts: DataFrame, model, key: list[str], max_tokens: int | None) -> DataFrame:
    if isinstance(model, ngram.MixedModel) or model.order == 1:
        rolled = ngram.corpus_loss(texts, model, max_tokens=max_tokens)
        return rolled.select("run", "test_loss", X.perplexity(F.col("test_loss")).alias("perplexity"))
    losses = ngram.sequence_loss(texts, model, key, max_tokens=max_tokens)
    return metrics.loss_metrics(losses).drop("num_tokens")
