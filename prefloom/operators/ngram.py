"""Count-based word models: fit, mix with a base, loss per sample, loss per corpus.

A fitted model stands where the runs under evaluation hold a tuned network: rows in,
a loss per sample and run out. Everything is counts, equi-joins and sums.

Order 1:  p(w) = (c(w) + 1) / (N + V + 1), with one slot for unseen words.
Order 2:  p(w | x) = lam c(x, w) / c(x) + (1 - lam) p(w).
Mix:      p(w) = (1 - alpha) p_base(w) + alpha p_run(w).

The log of order 1 splits into ``ln(N + V + 1)`` per word and ``-ln(c + 1)`` for the
words a run has seen. So texts need an inner join with the counts only. Runs stay a frame:
metrics per run add its totals at the end, and only a result of one row per sample and run
sets the samples' sizes (not their words) beside the runs, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions import text as X
from prefloom.operators import metrics
from prefloom.operators.skew import salted_join
from prefloom.session import scratch_path

# Layout only: the runs that share a block, and the samples that meet one copy of it.
RUN_BLOCK = 1_000
SALT_ROWS = 100_000

# So many runs of a mix, or fewer, are columns of one pass over the pairs' words.
FEW_RUNS = 16

# Sums of the same terms in another order differ by less; such pairs are ties.
TIE = 1e-12


@dataclass
class NgramModel:
    """Counts per run: ``words(run, token, c)``, ``totals(run, n, v)`` and for order 2
    ``pairs(run, ctx, token, c)`` and ``contexts(run, ctx, c_ctx)``, the uses of a word with one after it."""

    order: int
    words: DataFrame
    totals: DataFrame
    pairs: DataFrame | None = None
    contexts: DataFrame | None = None

    def runs(self) -> DataFrame:
        return self.totals.select("run")

    def only(self, runs: DataFrame | list[str]) -> NgramModel:
        """The model of the runs named in a frame's ``run`` column, or in a list."""
        if not isinstance(runs, DataFrame):
            runs = self.words.sparkSession.createDataFrame([(r,) for r in runs], "run string")
        chosen = runs.select("run").distinct()
        keep = lambda df: df if df is None else df.join(chosen, "run", "left_semi")
        return NgramModel(self.order, *map(keep, (self.words, self.totals, self.pairs, self.contexts)))

    def save(self, path: str) -> None:
        """Write the counts once; the totals and contexts are made from what was written."""
        spark = self.words.sparkSession
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        words = spark.read.parquet(f"{path}/words")
        word_totals(words).write.mode("overwrite").parquet(f"{path}/totals")
        if self.pairs is not None:
            self.pairs.write.mode("overwrite").parquet(f"{path}/pairs")
            pair_contexts(spark.read.parquet(f"{path}/pairs")).write.mode("overwrite").parquet(f"{path}/contexts")

    @classmethod
    def load(cls, spark: SparkSession, path: str, order: int = 1) -> NgramModel:
        names = ["words", "totals"] + (["pairs", "contexts"] if order == 2 else [])
        return cls(order, **{name: spark.read.parquet(f"{path}/{name}") for name in names})

    def stored(self) -> NgramModel:
        """The model as tables in the shared folder, so that scoring does not fit it again."""
        spark = self.words.sparkSession
        path = scratch_path(spark, "model")
        self.save(path)
        return self.load(spark, path, self.order)


@dataclass
class MixedModel:
    """A base model with one run, and the runs laid over it with weight ``alpha``; order 1."""

    base: NgramModel
    adapter: NgramModel
    alpha: float = 0.5

    def only(self, runs: DataFrame | list[str]) -> MixedModel:
        return MixedModel(self.base, self.adapter.only(runs), self.alpha)

    def base_words(self) -> DataFrame:
        return self.base.words.select("token", F.col("c").alias("c_base"))

    def base_slots(self) -> Column:
        return self.base.totals.agg(F.max(_slots(F.col("n"), F.col("v")))).scalar()

    def run_slots(self) -> DataFrame:
        return self.adapter.totals.select("run", "v", _slots(F.col("n"), F.col("v")).alias("d_run"))

    def p(self, c_base: Column, d_base: Column, c_run: Column, d_run: Column) -> Column:
        return (F.lit(1.0 - self.alpha) * (c_base + 1) / d_base + F.lit(self.alpha) * (c_run + 1) / d_run)


def word_totals(words: DataFrame) -> DataFrame:
    """Uses ``n`` and different words ``v`` per run."""
    return words.groupBy("run").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))


def pair_contexts(pairs: DataFrame) -> DataFrame:
    """How often each word of a run stands before another: ``run, ctx, c_ctx``."""
    return pairs.groupBy("run", "ctx").agg(F.sum("c").alias("c_ctx"))


def pair_shares(pairs: DataFrame, model: NgramModel) -> DataFrame:
    """Beside each of some pairs of a model its share ``ratio`` of its context's uses, the count ``c`` of the
    word alone and the run's ``slots``: all that scoring asks of a pair.

    The look-ups are spread by the model's own counts, which are no lower than the
    different pairs a context starts or a word ends.
    """
    joined = salted_join(pairs.withColumnRenamed("c", "c_pair"), model.contexts, ["run", "ctx"], ["token"],
                         hot_from=model.contexts, weight="c_ctx")
    joined = salted_join(joined, model.words, ["run", "token"], ["ctx"], hot_from=model.words, weight="c")
    slots = model.totals.select("run", _slots(F.col("n"), F.col("v")).alias("slots"))
    joined = salted_join(joined, slots, ["run"], ["ctx", "token"], hot_from=model.totals, weight="n")
    return joined.select("run", "ctx", "token", (F.col("c_pair") / F.col("c_ctx")).alias("ratio"), "c", "slots")


def explode_words(df: DataFrame, keep: list[str], words: Column) -> DataFrame:
    """One row per word. An outer explode, since for an inner one the optimizer tests the
    array's size in a filter at the scan and so splits every text twice more."""
    return df.select(*keep, F.explode_outer(words).alias("token")).where(F.col("token").isNotNull())


def explode_uses(df: DataFrame, keep: list[str], words: Column) -> DataFrame:
    """As :func:`explode_words`, with the place ``_use`` of each word, which spreads equal words of a text."""
    return df.select(*keep, F.posexplode_outer(words).alias("_use", "token")).where(F.col("token").isNotNull())


def use_counts(df: DataFrame, words: Column) -> DataFrame:
    """``token, k``: the uses of each word over all texts."""
    return explode_words(df, [], words).groupBy("token").agg(F.count(F.lit(1)).alias("k"))


def explode_bigrams(df: DataFrame, keep: list[str], words: Column) -> DataFrame:
    return df.select(*keep, F.inline_outer(_bigrams(words)).alias("ctx", "token")).where(F.col("token").isNotNull())


def fit_ngram(df: DataFrame, text: str = "text", run: str = "run", order: int = 1) -> NgramModel:
    """Count words (and word pairs for order 2) of each run's texts."""
    if order not in (1, 2):
        raise ValueError("order must be 1 or 2")
    named = df.where(F.col(run).isNotNull()).select(F.col(run).alias("run"), F.col(text).alias("text"))
    tokenised = named.select("run", X.tokens(F.col("text")).alias("tokens"))
    words = (explode_words(tokenised, ["run"], F.col("tokens"))
             .groupBy("run", "token").agg(F.count(F.lit(1)).alias("c")))
    totals = word_totals(words)
    if order == 1:
        return NgramModel(1, words, totals)
    counted = (explode_bigrams(tokenised, ["run"], F.col("tokens"))
               .groupBy("run", "ctx", "token").agg(F.count(F.lit(1)).alias("c")))
    return NgramModel(2, words, totals, counted, pair_contexts(counted))


def pool(model: NgramModel, name: str = "base") -> NgramModel:
    """One model of all runs' texts: their counts summed by word; order 1."""
    summed = model.words.groupBy("token").agg(F.sum("c").alias("c"))
    words = summed.select(F.lit(name).alias("run"), "token", "c")
    return NgramModel(1, words, word_totals(words))


def _bigrams(tokens: Column) -> Column:
    """Each word with the next; zipped rather than by a lambda, which generated code cannot hold."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.arrays_zip(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n))


def _slots(n: Column, v: Column) -> Column:
    return (n + v + 1).cast("double")


def _beside_runs(df: DataFrame, runs: DataFrame, key: list[str], counted: DataFrame | None = None) -> DataFrame:
    """Each row of ``df`` beside every run, for results that have a row for both.

    Runs are packed in blocks of about RUN_BLOCK by hash, and rows meet each block through an
    equi-join on its number and a salt of their key, so no task holds all of either side. There is
    a salt for every SALT_ROWS rows, counted on ``counted`` where that is cheaper and no smaller.
    """
    blocks = runs.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / RUN_BLOCK)).cast("int")).scalar()
    rows = df if counted is None else counted
    salts = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SALT_ROWS)).cast("int")).scalar()
    packed = runs.withColumn("_block", F.pmod(F.xxhash64("run"), blocks).cast("int")).groupBy("_block").agg(
        F.collect_list(F.struct(*runs.columns)).alias("_runs"))
    packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    dealt = df.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn(
        "_salt", F.pmod(F.xxhash64(*key), salts).cast("int"))
    return dealt.join(packed, ["_block", "_salt"]).select(*df.columns, F.inline("_runs"))


def _beside(df: DataFrame, runs: DataFrame, key: list[str], own: bool, counted: DataFrame) -> DataFrame:
    """Rows beside their own run's facts, of which a run may have most rows, or beside each run's."""
    return salted_join(df, runs, ["run"], key, how="inner") if own else _beside_runs(df, runs, key, counted)


def mix(model: MixedModel) -> DataFrame:
    """The mixed probability of every word base or run has seen, per run."""
    known = _beside_runs(model.base_words(), model.adapter.runs(), ["token"])
    both = known.select("run", "token", "c_base", F.lit(0).cast("bigint").alias("c_run")).unionByName(
        model.adapter.words.select("run", "token", F.lit(0).cast("bigint").alias("c_base"), F.col("c").alias("c_run")))
    summed = both.groupBy("run", "token").agg(F.max("c_base").alias("c_base"), F.max("c_run").alias("c_run"))
    joined = salted_join(summed, model.run_slots(), ["run"], ["token"], how="inner").withColumn("d_base", model.base_slots())
    return joined.select("run", "token", model.p(*map(F.col, ("c_base", "d_base", "c_run", "d_run"))).alias("p"))


# ------------------------------------------------------------------- losses

def sequence_loss(samples: DataFrame, model: NgramModel | MixedModel, key: list[str],
                  text: str = "text", runs: DataFrame | list[str] | None = None,
                  max_tokens: int | None = None, lam: float = 0.5,
                  own_run: str | None = None) -> DataFrame:
    """Mean loss of each sample under each run: ``key, run, loss, num_tokens``.

    ``key`` tells samples apart. ``runs`` names those to score under (None: all). ``max_tokens``
    cuts the scored text (None scores it whole). With ``own_run`` a sample is scored under the
    run named in that column only. Samples without a predicted word are left out.
    """
    if runs is not None:
        model = model.only(runs)
    own = [F.col(own_run).alias("run")] if own_run else []
    tokenised = samples.select(*key, *own, X.tokens(F.col(text), max_tokens).alias("tokens"))
    group = [*key, "run"] if own_run else key
    if isinstance(model, MixedModel):
        return _mixed_loss(tokenised, model, key, group)
    predicted = _predicted(F.col("tokens"), model.order)
    sizes = tokenised.select(*group, F.size("tokens").cast("bigint").alias("num_tokens"),
                             predicted.cast("bigint").alias("predicted")).where(F.col("predicted") > 0)
    totals = model.totals.select("run", _per_word(model.order, lam).alias("per_word"))
    rows = _beside(sizes, totals, key, bool(own), samples).withColumn("gain", F.lit(0.0))
    hits = _hits(tokenised, model, key, group, lam).select(
        *key, "run", F.lit(0).cast("bigint").alias("num_tokens"), F.lit(0).cast("bigint").alias("predicted"),
        F.lit(0.0).alias("per_word"), "gain")
    summed = rows.unionByName(hits).groupBy(*key, "run").agg(
        F.sum("num_tokens").alias("num_tokens"), F.sum("predicted").alias("predicted"),
        F.max("per_word").alias("per_word"), F.sum("gain").alias("gain")).where(F.col("predicted") > 0)
    return summed.select(*key, "run", (F.col("per_word") - F.col("gain") / F.col("predicted")).alias("loss"), "num_tokens")


def _predicted(tokens: Column, order: int) -> Column:
    return F.size(tokens) if order == 1 else F.size(tokens) - 1


def _per_word(order: int, lam: float) -> Column:
    """Loss of a word that the run has not seen."""
    unseen = F.log(_slots(F.col("n"), F.col("v")))
    return unseen if order == 1 else unseen - F.log(F.lit(1.0 - lam))


def _hits(tokenised: DataFrame, model: NgramModel, key: list[str], group: list[str], lam: float) -> DataFrame:
    """What seen words, and seen pairs beyond them, take off the loss: ``group, run, gain``.

    ``group`` holds the key, and ``run`` where samples are scored under their own.
    """
    on = ["run"] if "run" in group else []
    out = [c for c in group if c != "run"] + ["run"]
    seen = F.col("tokens") if model.order == 1 else F.slice("tokens", 2, F.size("tokens"))
    # A row per use: what uses take off adds up, and counting them first would hold a task's texts by word.
    # Across runs a count by word, which adds up before its shuffle, tells hot words for less than a sketch.
    hot = {} if on else {"hot_from": use_counts(tokenised, seen), "weight": "k"}
    found = salted_join(explode_uses(tokenised, group, seen), model.words, [*on, "token"], [*key, "_use"], how="inner", **hot)
    gains = found.select(*out, F.log(F.col("c") + F.lit(1.0)).alias("gain"))
    if model.order == 1:
        return gains
    pairs = explode_bigrams(tokenised, group, F.col("tokens")).groupBy(*group, "ctx", "token").agg(F.count(F.lit(1)).alias("k"))
    # Shares are worked out for the pairs that the samples use, of which a model has many more.
    used = model.pairs.join(pairs.select(*on, "ctx", "token").distinct(), [*on, "ctx", "token"], "left_semi")
    found = salted_join(pairs, pair_shares(used, model), [*on, "ctx", "token"], key, how="inner", weight="k")
    word = F.lit(1.0 - lam) * (F.col("c") + 1) / F.col("slots")
    return gains.unionByName(found.select(
        *out, (F.col("k") * (F.log(F.lit(lam) * F.col("ratio") + word) - F.log(word))).alias("gain")))


def _mixed_loss(tokenised: DataFrame, model: MixedModel, key: list[str], group: list[str]) -> DataFrame:
    """Loss under a mix, which does not split into a part of the word and one of the run.

    As if the run had seen no word, a sample's loss depends on its words' base counts only, so
    each run meets a list of a sample's different base counts. What the words that a run has
    seen change comes from an inner join.
    """
    own = "run" in group
    counted = (explode_words(tokenised, group, F.col("tokens"))
               .groupBy(*group, "token").agg(F.count(F.lit(1)).alias("k")))
    found = salted_join(counted, model.base_words(), ["token"], group, weight="k")
    found = found.withColumn("c_base", F.coalesce("c_base", F.lit(0).cast("bigint")))
    listed = found.groupBy(*group, "c_base").agg(F.sum("k").alias("k")).groupBy(*group).agg(
        F.collect_list(F.struct("c_base", "k")).alias("uses"), F.sum("k").alias("num_tokens"))
    rows = _beside(listed, model.run_slots().drop("v"), key, own, tokenised).withColumn("d_base", model.base_slots())
    unseen = F.aggregate("uses", F.lit(0.0), lambda acc, u: acc - u["k"] * F.log(
        model.p(u["c_base"], F.col("d_base"), F.lit(0), F.col("d_run"))))
    hits = salted_join(found, _sized_words(model), ["run", "token"] if own else ["token"], key, how="inner", weight="k")
    both = rows.select(*key, "run", unseen.alias("loss"), "num_tokens").unionByName(
        _seen_change(hits, model).select(*key, "run", "loss", F.lit(0).cast("bigint").alias("num_tokens")))
    summed = both.groupBy(*key, "run").agg(F.sum("loss").alias("loss"), F.sum("num_tokens").alias("num_tokens"))
    return summed.select(*key, "run", (F.col("loss") / F.col("num_tokens")).alias("loss"), "num_tokens")


def _sized_words(model: MixedModel) -> DataFrame:
    """The runs' word counts with the run's denominator beside them."""
    slots = model.run_slots()
    return salted_join(model.adapter.words, slots.drop("v"), ["run"], ["token"], how="inner", hot_from=slots, weight="v")


def _seen_change(hits: DataFrame, model: MixedModel) -> DataFrame:
    """``loss``: what ``k`` uses of a word change because the run has seen it."""
    at = lambda c_run: F.log(model.p(F.col("c_base"), F.col("d_base"), c_run, F.col("d_run")))
    return hits.withColumn("d_base", model.base_slots()).withColumn("loss", F.col("k") * (at(F.lit(0)) - at(F.col("c"))))


def corpus_loss(samples: DataFrame, model: NgramModel | MixedModel, text: str = "text",
                max_tokens: int | None = None, runs: DataFrame | list[str] | None = None) -> DataFrame:
    """Token-weighted loss of all samples per run, order 1, without per-sample rows.

    Uses are counted per word over the whole test set before they meet the model, so
    both join sides have one row per word (and run) and no key is hot.
    """
    if isinstance(model, NgramModel) and model.order != 1:
        raise ValueError("only order 1 sums over words alone; use sequence_loss")
    if runs is not None:
        model = model.only(runs)
    uses = use_counts(samples, X.tokens(F.col(text), max_tokens))
    num_tokens = uses.agg(F.coalesce(F.sum("k"), F.lit(0))).scalar()
    if isinstance(model, MixedModel):
        summed = _mixed_sums(uses, model)
    else:
        hits = uses.join(model.words, "token").groupBy("run").agg(
            F.sum(F.col("k") * F.log(F.col("c") + F.lit(1.0))).alias("gain"))
        summed = model.totals.join(hits, "run", "left").withColumn("num_tokens", num_tokens).select(
            "run", (F.col("num_tokens") * _per_word(1, 0.0) - F.coalesce("gain", F.lit(0.0))).alias("loss"))
    counted = summed.withColumn("num_tokens", num_tokens)
    loss = F.when(F.col("num_tokens") > 0, F.col("loss") / F.col("num_tokens")).otherwise(0.0)
    return counted.select("run", loss.alias("test_loss"), "num_tokens")


def _mixed_sums(uses: DataFrame, model: MixedModel) -> DataFrame:
    """Summed loss per run of ``uses(token, k)``, with a row for every run."""
    based = uses.join(model.base_words(), "token", "left").withColumn("c_base", F.coalesce("c_base", F.lit(0).cast("bigint")))
    by_count = based.groupBy("c_base").agg(F.sum("k").alias("k"))
    rows = _beside_runs(by_count, model.run_slots().drop("v"), ["c_base"]).withColumn("d_base", model.base_slots())
    unseen = -F.col("k") * F.log(model.p(F.col("c_base"), F.col("d_base"), F.lit(0), F.col("d_run")))
    changes = _seen_change(based.join(_sized_words(model), "token"), model)
    parts = [rows.select("run", unseen.alias("loss")), changes.select("run", "loss"),
             model.adapter.totals.select("run", F.lit(0.0).alias("loss"))]
    return reduce(DataFrame.unionByName, parts).groupBy("run").agg(F.sum("loss").alias("loss"))


# -------------------------------------------------------------- preferences

def _side(pairs: DataFrame, side: str) -> Column:
    """The text of a side of text or chat pairs."""
    return X.format_messages_strict(F.col(side)) if pairs.schema[side].dataType.typeName() == "array" else F.col(side)


def pair_texts(pairs: DataFrame, key: list[str]) -> DataFrame:
    """``key, chosen, rejected``: the sides of text or chat pairs as the texts that are scored."""
    return pairs.select(*key, *[_side(pairs, s).alias(s) for s in ("chosen", "rejected")])


def preference_losses(pairs: DataFrame, model: NgramModel | MixedModel, key: list[str],
                      runs: DataFrame | list[str] | None = None, max_tokens: int | None = None,
                      lam: float = 0.5) -> DataFrame:
    """``key, run, chosen_loss, rejected_loss`` of text or chat pairs."""
    if isinstance(model, MixedModel):
        model = model if runs is None else model.only(runs)
        runs, few = None, model.run_slots().limit(FEW_RUNS + 1).collect()
        if 0 < len(few) <= FEW_RUNS:
            return _mixed_pair_losses(pairs, model, [(r["run"], r["d_run"]) for r in few], key, max_tokens)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), _side(pairs, s).alias("text")) for s in ("chosen", "rejected")])
    unpaired = pairs.select(*key, F.inline(sides)).where(F.col("text").isNotNull())
    losses = sequence_loss(unpaired, model, [*key, "side"], "text", runs, max_tokens, lam)
    wide = losses.groupBy(*key, "run").agg(*[
        F.max(F.when(F.col("side") == s, F.col("loss"))).alias(f"{s}_loss") for s in ("chosen", "rejected")])
    return wide.where(F.col("chosen_loss").isNotNull() & F.col("rejected_loss").isNotNull())


def _mixed_pair_losses(pairs: DataFrame, model: MixedModel, slots: list[tuple[str, float]], key: list[str],
                       max_tokens: int | None) -> DataFrame:
    """As :func:`preference_losses`, for a mix of few runs, given with their denominators.

    A word's loss under each run is a column of the word's row, worked out once, so words meet one table,
    and the sums of all runs add up in one grouping by pair.
    """
    names = [name for name, _ in slots]
    c_run, loss = [f"_c{i}" for i in range(len(names))], [f"_loss{i}" for i in range(len(names))]
    seen = model.adapter.words.groupBy("token").agg(*[
        F.max(F.when(F.col("run") == name, F.col("c"))).alias(c) for name, c in zip(names, c_run)])
    known = model.base_words().join(seen, "token", "full").withColumn("d_base", model.base_slots())
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    cost = lambda c_base, c, d: -F.log(model.p(none(c_base), F.col("d_base"), none(c), F.lit(d)))
    known = known.select("token", *[
        cost(F.col("c_base"), F.col(c), d).alias(name) for c, name, (_, d) in zip(c_run, loss, slots)])
    sides = F.array(*[F.struct(F.lit(s).alias("side"), X.tokens(_side(pairs, s), max_tokens).alias("tokens"))
                      for s in ("chosen", "rejected")])
    unpaired = pairs.select(*key, F.inline(sides))
    uses = explode_uses(unpaired, [*key, "side"], F.col("tokens"))
    found = salted_join(uses, known, ["token"], [*key, "_use"], hot_from=use_counts(unpaired, F.col("tokens")), weight="k")
    found = found.withColumn("d_base", model.base_slots())
    zero = F.lit(None).cast("bigint")
    each = [F.coalesce(F.col(name), cost(zero, zero, d)) for name, (_, d) in zip(loss, slots)]
    on = {s: F.col("side") == s for s in ("chosen", "rejected")}
    summed = found.groupBy(*key).agg(
        *[F.count_if(on[s]).alias(f"_n_{s}") for s in on],
        *[F.sum(F.when(on[s], c)).alias(f"_{s}{i}") for s in on for i, c in enumerate(each)])
    losses = F.array(*[F.struct(
        F.lit(name).alias("run"), *[(F.col(f"_{s}{i}") / F.col(f"_n_{s}")).alias(f"{s}_loss") for s in on])
        for i, name in enumerate(names)])
    return summed.where((F.col("_n_chosen") > 0) & (F.col("_n_rejected") > 0)).select(*key, F.inline(losses))


def preference_rollup(pairs: DataFrame, model: NgramModel | MixedModel, key: list[str],
                      runs: DataFrame | list[str] | None = None, max_tokens: int | None = None,
                      lam: float = 0.5) -> DataFrame:
    """Preference metrics per run, the same as of :func:`preference_losses`.

    What an unseen word costs is the same on both sides, so pairs are compared by what seen
    words take off; pairs without such words are ties, and count through the totals only.
    """
    if isinstance(model, MixedModel):
        return metrics.preference_metrics(preference_losses(pairs, model, key, runs, max_tokens, lam))
    if runs is not None:
        model = model.only(runs)
    cut = {s: X.tokens(_side(pairs, s), max_tokens) for s in ("chosen", "rejected")}
    n = {s: _predicted(F.col(s), model.order) for s in cut}
    both = pairs.select(*key, *[t.alias(s) for s, t in cut.items()]).where((n["chosen"] > 0) & (n["rejected"] > 0))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), n[s].alias("predicted"), F.col(s).alias("tokens")) for s in cut])
    unpaired = both.select(*key, F.inline(sides))
    hits = _hits(unpaired, model, key, [*key, "side", "predicted"], lam)
    mean = lambda s: F.sum(F.when(F.col("side") == s, F.col("gain") / F.col("predicted")).otherwise(0.0)).alias(s)
    by_pair = hits.groupBy(*key, "run").agg(mean("chosen"), mean("rejected"))
    by_run = by_pair.groupBy("run").agg(
        F.count_if(F.col("chosen") - F.col("rejected") > TIE).alias("right"),
        F.sum("chosen").alias("chosen"), F.sum("rejected").alias("rejected"))
    total = both.agg(F.count(F.lit(1))).scalar()
    rolled = model.totals.join(by_run, "run", "left").withColumn("preference_total", total).where("preference_total > 0")
    count = F.col("preference_total")
    loss = lambda s: _per_word(model.order, lam) - F.coalesce(s, F.lit(0.0)) / count
    right = F.coalesce("right", F.lit(0).cast("bigint"))
    return rolled.select(
        "run", (right / count).alias("preference_accuracy"), right.alias("preference_correct"), "preference_total",
        loss("chosen").alias("avg_chosen_loss"), loss("rejected").alias("avg_rejected_loss"),
        (loss("rejected") - loss("chosen")).alias("loss_margin"))
