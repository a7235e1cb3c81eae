"""Operator inputs derived from the given tables, whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions import text as X
from prefloom.operators.rewards import GROUP_SIZE, mean_pool
from prefloom.operators.skew import salted_join

METHODS = ["sft", "dpo", "orpo", "kto", "grpo"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chat(spark: SparkSession, sf: str) -> DataFrame:
    """One row per conversation with its messages in turn order."""
    turns = table(spark, sf, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.transform(
        ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Every user text ``u`` with the reply ``a`` of the turn after it, null when there is none."""
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("u"))
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return asked.join(replies, ["conv_id", "turn"], "left")


def _turn(role: str, content: str) -> Column:
    return F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))


def _neighbours(spark: SparkSession, sf: str, how: str) -> DataFrame:
    """Each exchange beside the first reply of the next conversation, the last beside the first."""
    turns = table(spark, sf, "conversations")
    n = turns.agg(F.max("conv_id") + 1).scalar()
    first = F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn")))
    other = turns.groupBy(F.col("conv_id").alias("next_id")).agg(first.alias("r"))
    own = exchanges(spark, sf).withColumn("next_id", (F.col("conv_id") + 1) % n)
    return salted_join(own, other, ["next_id"], ["conv_id", "turn"], how).drop("next_id")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Preference pairs of every exchange: own reply chosen, the next conversation's first rejected."""
    full = _neighbours(spark, sf, "inner").where(
        F.col("u").isNotNull() & F.col("a").isNotNull() & F.col("r").isNotNull())
    return full.select(
        "conv_id", "turn", F.col("u").alias("prompt"),
        F.array(_turn("user", "u"), _turn("assistant", "a")).alias("chosen"),
        F.array(_turn("user", "u"), _turn("assistant", "r")).alias("rejected"),
        (F.length("a") % 5 + 1).cast("double").alias("score_chosen"),
        (F.length("r") % 5 + 1).cast("double").alias("score_rejected"))


def gappy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of every exchange, with null and empty sides among them."""
    return _neighbours(spark, sf, "left").select(
        "conv_id", "turn",
        F.when(F.col("a").isNotNull(), F.array(_turn("user", "u"), _turn("assistant", "a"))).alias("chosen"),
        F.when(F.col("r").isNotNull(), F.filter(
            F.array(_turn("user", "u"), _turn("assistant", "r")),
            lambda _: F.length("r") % 3 != 0)).alias("rejected"))


def torn(messages: Column) -> Column:
    """The messages, with the content gone where its length is a multiple of 97."""
    return F.transform(messages, lambda m: F.struct(
        m["role"].alias("role"), F.when(F.length(m["content"]) % 97 != 0, m["content"]).alias("content")))


def torn_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with broken messages, and no messages at all where their number is a multiple of 5."""
    return chat(spark, sf).withColumn("messages", F.when(F.size("messages") % 5 != 0, torn(F.col("messages"))))


def torn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with null and empty sides and broken messages among them."""
    sides = {side: torn(F.col(side)) for side in ("chosen", "rejected")}
    return gappy_pairs(spark, sf).withColumns(sides)


def raw_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a pasted JSON text of one of seven kinds, good and bad."""
    d = table(spark, sf, "documents").repartition("doc_id")  # as in train_docs
    turns = F.array(_turn("user", "source"), _turn("assistant", "text"))
    pair = [F.col("source").alias("prompt"), F.col("text").alias("chosen"), F.col("lang").alias("rejected")]
    kinds = [
        F.to_json(F.struct(turns.alias("messages"))),
        F.to_json(F.struct(*pair)),
        F.to_json(F.struct(pair[0], F.col("text").alias("completion"), (F.col("n_chars") % 2).alias("label"))),
        F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]")),
        F.lit("bad{"),
        F.lit('{"other":1}'),
        F.regexp_replace(F.to_json(F.struct(*pair)), r"^\{", '{"messages":null,'),
    ]
    m = F.col("doc_id") % 7
    text = F.when(m == 0, kinds[0])
    for i, kind in enumerate(kinds[1:], 1):
        text = text.when(m == i, kind)
    return d.select("doc_id", text.alias("text"))


def run_name() -> Column:
    """Each user's events are one run's, named after one of the five methods."""
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), (F.col("user_id") % 5 + 1).cast("int"))
    return F.concat(method, F.lit("_"), F.col("user_id").cast("string"))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as training-log entries in event order."""
    e = table(spark, sf, "events")
    value = lambda *kinds: F.when(F.col("event_type").isin(*kinds), F.col("value"))
    return e.select(
        run_name().alias("run"), F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM").alias("month"),
        value("click", "view", "signup").alias("loss"),
        value("purchase", "signup").alias("eval_loss"),
        value("error").alias("train_runtime"))


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Steps and best checkpoint per run."""
    e = table(spark, sf, "events").select(run_name().alias("run"), "event_id", "event_type", "value")
    best = F.min_by("event_id", F.when(F.col("event_type") == "purchase", F.col("value") * 1e9 + F.col("event_id")))
    return e.groupBy("run").agg(
        F.count(F.lit(1)).alias("global_step"),
        F.concat(F.lit("checkpoint-"), best.cast("string")).alias("best_model_checkpoint"))


def artefacts(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a file of its run's folder."""
    e = table(spark, sf, "events")
    u, kind = F.col("user_id"), F.col("event_type")
    folder = F.concat(F.lit("checkpoint-"), ((F.col("event_id") % 15 + 1) * 100).cast("string"), F.lit("/"))
    weights = F.when(u % 7 == 3, "optimizer.pt").otherwise(X.ADAPTER_FILE)
    path = (
        F.when(kind == "signup", F.when(u % 3 == 0, "model.safetensors").otherwise(X.ADAPTER_CONFIG_FILE))
        .when((kind == "purchase") & (u % 20 < 6), weights)
        .when(kind.isin("purchase", "click"), F.concat(folder, weights))
        .otherwise(F.concat(folder, F.lit(X.TRAINER_STATE_FILE))))
    return e.select("event_id", F.concat(F.lit("runs/"), run_name()).alias("run"), path.alias("rel_path"))


# Kinds of run folders: name, files at the root, whether the root or the checkpoints hold trainer states.
KINDS = [
    ("sft ", [X.ADAPTER_FILE, X.ADAPTER_CONFIG_FILE], "root"),
    ("DPO_", ["model.safetensors"], "checkpoints"),
    ("orpo_", [X.ADAPTER_FILE], "checkpoints"),
    ("kto [x] ", [X.ADAPTER_FILE, X.ADAPTER_CONFIG_FILE], "some checkpoints"),
    ("grpo_", ["pytorch_model.bin", X.ADAPTER_CONFIG_FILE], "root"),
    ("drafts_", ["notes.txt"], "checkpoints"),
]

# What orders a file's pieces.
PIECES = ["folder", "part", "entry"]


def kind_name(group: Column) -> Column:
    """Name of a group's run folder."""
    kind = F.element_at(F.array(*[F.lit(name) for name, _, _ in KINDS]), (group % len(KINDS) + 1).cast("int"))
    return F.concat(kind, group.cast("string"))


def run_tree(spark: SparkSession, sf: str, group: Column) -> DataFrame:
    """The files of one run folder per group of events, of six kinds, in pieces: ``path, folder, part, entry, text``.

    A group's events are dealt over checkpoints 800, 900 and 1000, whose trainer states log them;
    the states at a root log them all. Some checkpoints hold an adapter and no state. A piece is an ``entry``
    of a state's log, to be written as JSON, or a ``text``. A file's pieces are ordered by PIECES.
    """
    e = table(spark, sf, "events")
    value = lambda *kinds: F.when(F.col("event_type").isin(*kinds), F.col("value"))
    entry = F.struct(F.col("event_id").alias("step"), value("click", "view", "signup").alias("loss"),
                     value("purchase", "signup").alias("eval_loss"), value("error").alias("train_runtime"))
    folder = F.concat(F.lit("checkpoint-"), ((F.col("event_id") % 3 + 8) * 100).cast("string"))
    logged = e.select(group.alias("g"), entry.alias("entry"), F.explode(F.array(folder, F.lit(""))).alias("folder"))
    kind = F.col("g") % len(KINDS)
    at = lambda place: kind.isin([i for i, k in enumerate(KINDS) if k[2] == place])
    has_state = F.when(F.col("folder") == "", at("root")).when(
        F.col("folder") == "checkpoint-1000", ~at("some checkpoints")).otherwise(F.lit(True))
    below = lambda name: F.concat(kind_name(F.col("g")), F.lit("/"), name)
    piece = lambda path, part, entry, text: [
        path.alias("path"), "folder", part.alias("part"), entry.alias("entry"), text.alias("text")]
    nested = below(F.concat_ws("/", F.nullif("folder", F.lit("")), "name"))
    entries = logged.where(has_state).withColumn("name", F.lit(X.TRAINER_STATE_FILE)).select(
        *piece(nested, F.lit(1), F.col("entry"), F.lit(None)))
    state = F.to_json(F.struct(F.col("n").alias("global_step"), F.nullif("folder", F.lit("")).alias("best_model_checkpoint")))
    state_file, adapter = F.when(has_state, F.lit(X.TRAINER_STATE_FILE)), F.when(F.col("folder") != "", F.lit(X.ADAPTER_FILE))
    of_file = lambda name, part, text: F.struct(name.alias("name"), F.lit(part).alias("part"), text.alias("text"))
    folders = logged.groupBy("g", "folder").agg(F.count(F.lit(1)).alias("n")).select("g", "folder", F.inline(F.array(
        of_file(state_file, 0, F.regexp_replace(state, r"\}$", ',"log_history":[')), of_file(state_file, 2, F.lit("]}")),
        of_file(adapter, 0, F.col("folder")))))
    around = folders.where("name is not null").select(*piece(nested, F.col("part"), F.lit(None), F.col("text")))
    names = F.element_at(F.array(*[F.array(*[F.lit(n) for n in files]) for _, files, _ in KINDS]), (kind + 1).cast("int"))
    roots = e.select(group.alias("g")).distinct().select("g", F.lit("").alias("folder"), F.explode(names).alias("name"))
    whole = roots.select(*piece(below(F.col("name")), F.lit(0), F.lit(None), F.col("g").cast("string")))
    return entries.unionByName(around).unionByName(whole)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """One row of metrics per run, with gaps."""
    e = table(spark, sf, "events").select("user_id", run_name().alias("run"), "event_type", "value")
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    r = e.groupBy("user_id", "run").agg(
        mean("click").alias("p"), mean("view").alias("t"), mean("purchase").alias("m"), F.count(F.lit(1)).alias("n"))
    u = F.col("user_id")
    return r.select(
        "run", F.concat(F.lit("runs/"), F.col("run")).alias("model_path"),
        F.when(u % 7 != 0, F.col("p")).alias("perplexity"),
        F.when(u % 5 != 0, F.col("t")).alias("test_loss"),
        F.when(u % 3 != 0, F.round(F.col("m") / 100, 2)).alias("preference_accuracy"),
        (F.col("p") - F.col("t")).alias("loss_margin"),
        F.col("n").alias("total_steps"))


def generations(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's exchanges as one run's generation samples, numbered from 0."""
    return exchanges(spark, sf).select(
        F.concat(F.lit("run_"), F.col("conv_id").cast("string")).alias("run"),
        F.expr("turn div 2").alias("pos"), F.col("u").alias("prompt"), F.coalesce("a", F.lit("")).alias("response"))


def label_means(spark: SparkSession, sf: str) -> DataFrame:
    return mean_pool(table(spark, sf, "embeddings"), ["label"], "embedding", "mean")


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as a completion beside its own and the next label's mean."""
    means = label_means(spark, sf)
    n = table(spark, sf, "embeddings").agg(F.max("label") + 1).scalar()
    e = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.expr(f"vec_id div {GROUP_SIZE}").alias("prompt_id"),
        F.col("embedding").cast("array<double>").alias("y"), ((F.col("label") + 1) % n).alias("other"),
        (F.col("vec_id") % 5 + 1).cast("double").alias("score_chosen"),
        (F.col("vec_id") % 3 + 1).cast("double").alias("score_rejected"))
    own = salted_join(e, means.withColumnRenamed("mean", "chosen"), ["label"], ["vec_id"], "inner")
    return salted_join(own, means.select(F.col("label").alias("other"), F.col("mean").alias("rejected")),
                       ["other"], ["vec_id"], "inner", hot_from=e)


def train_docs(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as training texts, one run per language."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("run"), "text")
    return docs.repartition("doc_id")  # the test tables are single files of one row group, which one task would split


def chat_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations as test texts."""
    return chat(spark, sf).select("conv_id", X.format_messages(F.col("messages")).alias("text"))
