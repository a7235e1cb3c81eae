"""Registered queries: every operator over the given tables, with flat rounded output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prefloom.functions import json as J
from prefloom.functions import text as X
from prefloom.functions.vectors import cosine
from prefloom.operators import (
    catalog, contracts, leaderboard, metrics, ngram, project, records, rewards, sample,
)
from prefloom.plans import evaluate, ingest, prepare, registry
from prefloom.plans import rewards as reward_plans
from prefloom.session import configure, scratch_path
from prefloom.sources import readers, sinks
from suite import frames

# Tells the exchanges of all conversations apart.
EXCHANGE = ["conv_id", "turn"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(configure(spark), sf.rstrip("/"))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c)
                      for c in df.columns])


def shown(name: str) -> Column:
    return X.format_messages(F.col(name)).alias(name)


# ------------------------------------------------------------- prepare rows

@query
def sft_text(spark, sf):
    rows = prepare.prepare("sft", frames.chat(spark, sf), ["conv_id"])
    return rows.select("conv_id", X.format_messages(F.col("messages")).alias("text"))


@query
def sft_from_pairs(spark, sf):
    both = frames.pairs(spark, sf).withColumn("messages", F.col("rejected"))
    rows = prepare.prepare("sft", both, EXCHANGE)
    return rows.select(*EXCHANGE, shown("messages"), "score_chosen")


@query
def split_scan(spark, sf):
    docs = frames.table(spark, sf, "documents")
    train, held_out = prepare.prepare_splits("sft", docs, ["doc_id"], "en", "fr", max_eval=100, column="lang")
    pick = lambda df, name: df.select("doc_id", F.lit(name).alias("part"), "n_chars")
    return pick(train, "train").unionByName(pick(held_out, "eval"))


@query
def table_split(spark, sf):
    """Documents stored by language as a partitioned table, one split of which is read by name."""
    path = scratch_path(spark, "splits")
    frames.table(spark, sf, "documents").withColumnRenamed("lang", "split").write.partitionBy("split").parquet(path)
    view = f"documents_{abs(hash(path))}"
    spark.read.parquet(path).createOrReplaceTempView(view)
    return readers.named_split(spark, view, "fr").select("doc_id", "split", "n_chars")


@query
def prepare_path(spark, sf):
    """Rows by path: two splits of a nested folder, and a whole file without splits."""
    path = scratch_path(spark, "nested")
    docs = frames.table(spark, sf, "documents")
    docs.withColumn("split", F.col("lang")).withColumn("kind", F.col("doc_id") % 2).write.partitionBy("kind", "split").parquet(path)
    train, held_out = prepare.prepare_path(spark, "sft", path, ["doc_id"], "de", "es", max_eval=200)
    whole, _ = prepare.prepare_path(spark, "sft", f"{sf}/documents.parquet", ["doc_id"])
    parts = [df.select("doc_id", F.lit(name).alias("part"), "n_chars")
             for name, df in (("train", train), ("eval", held_out), ("whole", whole))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def dpo_pairs(spark, sf):
    rows = prepare.prepare("dpo", frames.pairs(spark, sf).withColumn("messages", F.col("chosen")), EXCHANGE)
    return rows.select(*EXCHANGE, "prompt", shown("chosen"), shown("rejected"))


@query
def orpo_pairs(spark, sf):
    rows = prepare.prepare("ORPO", frames.pairs(spark, sf), EXCHANGE)
    return rows.select(*EXCHANGE, "prompt", shown("chosen"), shown("rejected"), "score_chosen", "score_rejected")


@query
def implicit_prompt(spark, sf):
    rows = project.with_prompt(frames.pairs(spark, sf).drop("prompt"))
    return rows.select(*EXCHANGE, shown("prompt"), shown("chosen"), shown("rejected"))


@query
def kto_unpair(spark, sf):
    rows = project.kto_rows(frames.pairs(spark, sf), keep=EXCHANGE)
    return rows.select(*EXCHANGE, "prompt", "completion", F.col("label").cast("int").alias("label"))


@query
def kto_text(spark, sf):
    ready = frames.pairs(spark, sf).select(
        *EXCHANGE, F.split("prompt", " ").alias("prompt"),
        F.get("chosen", 1)["content"].alias("completion"), F.col("score_chosen").cast("int").alias("label"))
    ready = ready.withColumn("label", F.col("label") % 2)
    rows = project.kto_rows(ready, keep=EXCHANGE)
    return rows.select(*EXCHANGE, "prompt", "completion", F.col("label").cast("int").alias("label"))


@query
def kto_sample(spark, sf):
    rows = prepare.prepare("kto", frames.pairs(spark, sf), EXCHANGE, limit=50)
    return rows.select(*EXCHANGE, "completion", F.col("label").cast("int").alias("label"))


@query
def seeded_order(spark, sf):
    """Places of all unpaired rows in the seeded shuffle."""
    rows = project.kto_rows(frames.pairs(spark, sf), keep=EXCHANGE).select(*EXCHANGE, F.col("label").cast("int").alias("label"))
    return sample.seeded_order(rows, [*EXCHANGE, "label"])


@query
def first_rows(spark, sf):
    """Half of all events by the seeded shuffle, cut by counting between sampled keys."""
    e = frames.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    half = e.count() // 2
    return sample.take_first(e, half, ["event_id"], seed=7, top_rows=1000)


@query
def grpo_rows(spark, sf):
    return prepare.prepare("grpo", frames.pairs(spark, sf), EXCHANGE)


@query
def cap_position(spark, sf):
    df = frames.gappy_pairs(spark, sf)
    kept = sample.cap_by_position(df, 50, EXCHANGE, evaluate.both_sides(df))
    return kept.select(*EXCHANGE, shown("chosen"))


@query
def cap_valid(spark, sf):
    df = frames.gappy_pairs(spark, sf)
    return evaluate.valid_pairs(df, EXCHANGE, 50).select(*EXCHANGE, shown("rejected"))


@query
def valid_pairs(spark, sf):
    return evaluate.valid_pairs(frames.gappy_pairs(spark, sf), EXCHANGE).select(*EXCHANGE, shown("rejected"))


# ------------------------------------------------------------------- ingest

@query
def ingest_classify(spark, sf):
    accepted, _ = ingest.ingest(frames.raw_json(spark, sf))
    return accepted.select("doc_id", "type", "prompt", "chosen", "rejected", "completion",
                           F.col("label").cast("int").alias("label"), "text")


@query
def ingest_rejects(spark, sf):
    return ingest.ingest(frames.raw_json(spark, sf))[1]


@query
def ingest_parquet(spark, sf):
    """Texts written as files, then ingested from the folder to Parquet and rolled up."""
    pasted, out = scratch_path(spark, "pasted"), scratch_path(spark, "records")
    frames.raw_json(spark, sf).select("text").write.text(pasted)
    rows, rejects = ingest.ingest_path(spark, pasted, out, layout="lines")
    counts = rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return counts.unionByName(rejects.select(
        F.col("reject_reason").alias("type"), "n", F.lit(None).cast("bigint").alias("chars")))


@query
def strict_list(spark, sf):
    docs = frames.table(spark, sf, "documents")
    item = F.struct(F.col("source").alias("prompt"), F.col("text").alias("chosen"), F.col("lang").alias("rejected"))
    lists = docs.select("doc_id", F.to_json(F.array(item, item)).alias("text"))
    return readers.strict_list(lists).select(
        "doc_id", "item_pos", F.md5(F.try_variant_get("item", "$.chosen", "string")).alias("chosen_md5"))


@query
def typed_path(spark, sf):
    """Documents written as JSON lines and read back by the path's file type."""
    path = scratch_path(spark, "documents")
    frames.table(spark, sf, "documents").write.json(path)
    rows = readers.read_path(spark, path, "doc_id bigint, lang string, text string")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def contract_report(spark, sf):
    """How many pasted records hold the columns each method needs."""
    items = records.json_items(frames.raw_json(spark, sf))
    keys = items.where(F.col("item").isNotNull())
    hits = keys.select([
        F.count_if(contracts.accepts(m, lambda k: F.coalesce(J.has_key(F.col("item"), k), F.lit(False)))).alias(m)
        for m in contracts.CONTRACTS])
    return hits.unpivot([], list(contracts.CONTRACTS), "method", "n")


# --------------------------------------------------------------------- text

@query
def chat_prompt(spark, sf):
    return frames.chat(spark, sf).select("conv_id", X.chat_prompt(F.col("messages")).alias("prompt"))


@query
def last_assistant(spark, sf):
    return frames.chat(spark, sf).select("conv_id", X.last_assistant(F.col("messages")).alias("reply"))


@query
def gen_prompt(spark, sf):
    turns = frames.exchanges(spark, sf).where(X.not_blank(F.col("u")))
    return turns.select(*EXCHANGE, X.generation_prompt(F.col("u")).alias("prompt"),
                        X.format_messages(X.as_user_message(F.col("u"))).alias("as_chat"))


@query
def reply_extract(spark, sf):
    turns = frames.exchanges(spark, sf).where(F.col("a").isNotNull())
    marked = F.concat(X.generation_prompt(F.col("u")), F.lit("  "), F.col("a"), F.lit("\n"))
    plain = F.concat(F.col("u"), F.lit("\n "), F.col("a"))
    return turns.select(*EXCHANGE, X.reply_of(
        F.when(F.col("conv_id") % 2 == 0, marked).otherwise(plain), F.col("u")).alias("reply"))


@query
def message_literal(spark, sf):
    literal = frames.chat(spark, sf).select("conv_id", F.to_json("messages").alias("literal"))
    return literal.select("conv_id", X.format_messages(readers.parse_messages(F.col("literal"))).alias("text"))


@query
def truncate_tokens(spark, sf):
    docs = frames.table(spark, sf, "documents")
    cut = docs.select("doc_id", X.tokens(F.col("text"), X.MAX_TOKENS).alias("t"))
    return cut.select("doc_id", F.size("t").alias("num_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


# ------------------------------------------------------------------ rewards

@query
def distinct_char_reward(spark, sf):
    turns = frames.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    turns = turns.select("conv_id", "turn", F.array(F.struct("role", F.col("text").alias("content"))).alias("completion"))
    dtype = turns.schema["completion"].dataType
    return rewards.apply_reward(turns, lambda completion: rewards.distinct_char_reward(completion, dtype),
                                {"completion": "completion"}).drop("completion")


@query
def mean_pool(spark, sf):
    return rounded(frames.label_means(spark, sf).select("label", F.posexplode("mean").alias("dim", "value")))


@query
def cosine_to_mean(spark, sf):
    t = frames.triples(spark, sf)
    return rounded(t.select("vec_id", cosine(F.col("y"), F.col("chosen")).alias("own"),
                            cosine(F.col("y"), F.col("rejected")).alias("next")))


SIMILARITY = {"completion": "y", "chosen": "chosen", "rejected": "rejected",
              "score_chosen": "score_chosen", "score_rejected": "score_rejected"}


@query
def similarity_reward(spark, sf):
    scored = rewards.apply_reward(frames.triples(spark, sf), rewards.similarity_reward, SIMILARITY)
    return rounded(scored.select("vec_id", "reward"))


def _scored(spark, sf):
    return reward_plans.score_rewards(
        frames.triples(spark, sf), rewards.similarity_reward, SIMILARITY, "prompt_id", "vec_id")


@query
def group_advantage(spark, sf):
    return rounded(_scored(spark, sf)[0].select("vec_id", "prompt_id", "advantage"), 4)


@query
def best_of_group(spark, sf):
    return rounded(_scored(spark, sf)[1])


@query
def zero_scores(spark, sf):
    docs = frames.table(spark, sf, "documents")
    score = lambda n: F.when(F.col("doc_id") % n != 0, F.col("n_chars") % n).cast("double")
    scored = docs.select(score(3).alias("score_chosen"), score(2).alias("score_rejected"))
    return rounded(rewards.zero_score_share(scored))


# ---------------------------------------------------------- runs on disk

@query
def train_log_metrics(spark, sf):
    return rounded(metrics.training_metrics(frames.logs(spark, sf), frames.states(spark, sf)))


@query
def metrics_by_group(spark, sf):
    """Training figures per run and month, per run, and of all runs."""
    return rounded(metrics.training_by_group(frames.logs(spark, sf), "month"))


@query
def latest_adapter(spark, sf):
    return catalog.latest_adapter(frames.artefacts(spark, sf))


@query
def latest_checkpoint(spark, sf):
    return catalog.last_checkpoint(frames.artefacts(spark, sf))


@query
def latest_checkpoint_name(spark, sf):
    return catalog.last_checkpoint(frames.artefacts(spark, sf), "name")


@query
def state_files(spark, sf):
    return catalog.pick_state_file(frames.artefacts(spark, sf).select("run", "rel_path"))


def _run_folder(spark, sf, group):
    """A runs folder written from the events; its root's name is there twice in the path."""
    root = f"{scratch_path(spark, 'exp')}/runs/exp/runs"
    sinks.write_pieces(frames.run_tree(spark, sf, group), root, frames.PIECES, content=F.coalesce("text", F.to_json("entry")))
    return root


@query
def run_folder_scan(spark, sf):
    """A folder of one run per user, listed without reading a file."""
    files = readers.run_files(spark, _run_folder(spark, sf, F.col("user_id")))
    sized = F.when(~F.endswith("rel_path", F.lit(X.TRAINER_STATE_FILE)), F.col("bytes"))
    return files.select("run", "rel_path", sized.alias("bytes"))


@query
def trainer_state_read(spark, sf):
    """The one trainer state that counts of each run in a folder, rolled up."""
    states = readers.trainer_states(spark, _run_folder(spark, sf, F.col("user_id")))
    return rounded(metrics.training_metrics(metrics.log_rows(states), states))


@query
def run_inventory(spark, sf):
    runs = catalog.with_base(catalog.run_inventory(frames.artefacts(spark, sf)), "models/base")
    flags = [F.col(c).cast("int").alias(c) for c in ("has_adapter", "has_model", "has_config")]
    return runs.select("run", *flags, "kind", "load_as", "model", "adapter")


@query
def run_filter(spark, sf):
    found = catalog.run_inventory(frames.artefacts(spark, sf))
    return catalog.filter_runs(found, catalog.parse_methods(" dpo, kto ,")).select("run", "kind")


@query
def method_lists(spark, sf):
    """Names typed with commas and stray blanks, split to one row each."""
    e = frames.table(spark, sf, "events")
    typed = e.groupBy("user_id").agg(F.concat(
        F.lit(" "), F.array_join(F.array_sort(F.collect_set("event_type")), " , "), F.lit(" ,,")).alias("typed"))
    return typed.select("user_id", F.explode(X.method_list(F.col("typed"))).alias("name"))


@query
def catalogue_counts(spark, sf):
    return catalog.catalogue_counts(frames.artefacts(spark, sf), ["grpo"])


@query
def model_resolve(spark, sf):
    e = frames.table(spark, sf, "events")
    run = frames.run_name()
    asked = (F.when(F.col("event_type") == "click", F.concat(F.lit("runs/"), run))
             .when(F.col("event_type") == "view", run)
             .when(F.col("event_type") == "signup", F.lit("  "))
             .when(F.col("event_type") == "error", F.lit(" base\n"))
             .otherwise(F.concat(F.lit("old_"), run)))
    requests = e.select("event_id", asked.alias("request"))
    known = catalog.latest_adapter(frames.artefacts(spark, sf)).select(F.col("run").alias("path"))
    known = known.unionByName(known.agg(F.lit("runs/base").alias("path")))
    return catalog.resolve_models(requests, known, "runs", ["event_id"]).select("event_id", "resolved")


@query
def label_paths(spark, sf):
    e = frames.table(spark, sf, "events")
    step = F.concat(F.lit("/checkpoint-"), ((F.col("event_id") % 15 + 1) * 100).cast("string"))
    label = F.when(F.col("event_type") == "error", catalog.BASE_ONLY_LABEL).otherwise(
        F.concat(frames.run_name(), F.when(F.col("user_id") % 20 < 6, "").otherwise(step)))
    choices = e.select("event_id", label.alias("label"))
    return catalog.label_paths(choices, catalog.latest_adapter(frames.artefacts(spark, sf)), ["event_id"])


@query
def label_choices(spark, sf):
    return catalog.label_list(catalog.latest_adapter(frames.artefacts(spark, sf)))


# ------------------------------------------------------------ word models

def _model(spark, sf, order=1):
    return ngram.fit_ngram(frames.train_docs(spark, sf), order=order)


def _stored(spark, sf, order=1):
    return _model(spark, sf, order).stored()


@query
def lm_fit(spark, sf):
    return _model(spark, sf).words


@query
def lm_totals(spark, sf):
    return _model(spark, sf).totals


@query
def lm_pairs(spark, sf):
    return _model(spark, sf, 2).pairs


@query
def lm_overlay(spark, sf):
    model = _stored(spark, sf)
    mixed = ngram.mix(ngram.MixedModel(ngram.pool(model), model))
    return mixed.select("run", "token", F.round(F.log("p"), 6).alias("log_p"))


@query
def sequence_loss(spark, sf):
    losses = ngram.sequence_loss(frames.chat_texts(spark, sf), _stored(spark, sf), ["conv_id"], max_tokens=None)
    return rounded(losses)


@query
def sequence_loss_own(spark, sf):
    docs = frames.train_docs(spark, sf)
    return rounded(ngram.sequence_loss(docs, _stored(spark, sf), ["doc_id"], own_run="run", max_tokens=None))


@query
def sequence_loss_pairs(spark, sf):
    losses = ngram.sequence_loss(frames.chat_texts(spark, sf), _stored(spark, sf, 2), ["conv_id"], max_tokens=None)
    return rounded(losses, 5)


@query
def overlay_loss(spark, sf):
    runs = _stored(spark, sf)
    model = ngram.MixedModel(ngram.pool(runs).stored(), runs)
    return rounded(ngram.sequence_loss(frames.chat_texts(spark, sf), model, ["conv_id"], max_tokens=None), 5)


@query
def perplexity(spark, sf):
    rolled = ngram.corpus_loss(frames.chat_texts(spark, sf), _stored(spark, sf), max_tokens=None)
    return rolled.select("run", F.round("test_loss", 6).alias("test_loss"),
                         F.round(X.perplexity(F.col("test_loss")), 4).alias("perplexity"), "num_tokens")


@query
def perplexity_samples(spark, sf):
    """The same figures by way of per-sample losses."""
    losses = ngram.sequence_loss(frames.chat_texts(spark, sf), _stored(spark, sf), ["conv_id"], max_tokens=None)
    return registry.METRICS["loss"](losses).select(
        "run", F.round("test_loss", 6).alias("test_loss"), F.round("perplexity", 4).alias("perplexity"), "num_tokens")


@query
def preference_metrics(spark, sf):
    return rounded(ngram.preference_rollup(frames.pairs(spark, sf), _stored(spark, sf), EXCHANGE))


@query
def array_items(spark, sf):
    """Documents as files of one JSON array each, a thousand items over many lines, read back in splits."""
    docs = frames.table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 1000).alias("file"))
    item = F.replace(F.to_json(F.struct("doc_id", "text")), F.lit(',"text":'), F.lit(',\n  "text":'))
    order = Window.partitionBy("file").orderBy("doc_id")
    first, last = F.row_number().over(order) == 1, F.lead("doc_id").over(order).isNull()
    rows = docs.select("file", "doc_id", F.concat(
        F.when(first, "[").otherwise(""), item, F.when(last, "]").otherwise(",")).alias("value"))
    root = scratch_path(spark, "arrays")
    rows.sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(root)
    parsed = F.from_json("text", "doc_id bigint, text string")
    return readers.array_items(spark, root).select("item_pos", parsed.alias("d")).select(
        "d.doc_id", "item_pos", F.md5("d.text").alias("text_md5"))


@query
def scoring_rejects(spark, sf):
    """Test rows and pairs that an evaluation does not score, by reason."""
    return evaluate.reject_counts(frames.torn_chat(spark, sf), frames.torn_pairs(spark, sf))


# --------------------------------------------------------------- reporting

def _evaluated(spark, sf):
    logs = frames.logs(spark, sf)
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    user = F.split("run", "_")[1].cast("bigint")
    logs = logs.withColumn("run", F.element_at(langs, (user % 4 + 1).cast("int")))
    docs = frames.table(spark, sf, "documents")
    return evaluate.evaluate(
        docs.groupBy(F.col("lang").alias("run")).agg(F.count(F.lit(1)).alias("train_rows")), ["id"],
        model=_stored(spark, sf), test=frames.chat(spark, sf).withColumn("id", F.col("conv_id").cast("string")),
        prefs=frames.pairs(spark, sf).withColumn("id", F.concat_ws(":", *EXCHANGE)), logs=logs)


@query
def eval_table(spark, sf):
    return rounded(_evaluated(spark, sf).drop("training_time_hours"), 4)


@query
def summary_text(spark, sf):
    return metrics.summary_lines(_evaluated(spark, sf))


@query
def evaluate_runs(spark, sf):
    """A runs folder, and models of documents by source, to a published result file."""
    root = _run_folder(spark, sf, F.col("user_id") % 6)
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    docs = frames.table(spark, sf, "documents").select(frames.kind_name(number % 5).alias("run"), "text")
    model = ngram.fit_ngram(docs).stored()
    results = evaluate.evaluate_runs(
        spark, root, scratch_path(spark, "results"), ["id"], model, ngram.pool(model).stored(),
        test=frames.chat(spark, sf).withColumn("id", F.col("conv_id").cast("string")),
        prefs=frames.pairs(spark, sf).withColumn("id", F.concat_ws(":", *EXCHANGE)))
    short = F.regexp_extract("model_path", "exp/runs/[^/]+$", 0)
    return rounded(results.drop("generation_samples").withColumn("model_path", short), 4)


@query
def leaderboard_a(spark, sf):
    return rounded(leaderboard.leaderboard(frames.results(spark, sf), "a"))


@query
def leaderboard_b(spark, sf):
    return rounded(leaderboard.leaderboard(frames.results(spark, sf), "b"))


@query
def results_roundtrip(spark, sf):
    path = scratch_path(spark, "results")
    sinks.write_results(frames.results(spark, sf), path, "lines")
    back, message = readers.read_results(spark, path, "lines")
    if back is None:
        raise RuntimeError(message)
    return rounded(back.select("run", "model_path", "perplexity", "test_loss", "total_steps"))


@query
def run_samples(spark, sf):
    nested = metrics.nest_samples(frames.generations(spark, sf), 3)
    return nested.select("run", F.posexplode("generation_samples").alias("i", "s")).select("run", "i", "s.*")


@query
def samples_of_run(spark, sf):
    nested = metrics.nest_samples(frames.generations(spark, sf), 3)
    return leaderboard.samples_of(nested, "run_3").select("run", F.to_json("generation_samples").alias("samples"))
