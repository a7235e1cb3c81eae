"""Runs on disk as rows ``(run, rel_path)``: inventory, newest adapter, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions import text as X
from prefloom.operators.skew import salted_join

# Fixed values.
DEFAULT_BASE = "base"
BASE_ONLY_LABEL = "(仅基座模型)"
CHECKPOINT_PREFIX = "checkpoint-"


def _at_root(name: str) -> Column:
    return F.col("rel_path") == name


def run_inventory(files: DataFrame) -> DataFrame:
    """Per run: does its root hold an adapter, a full model, an adapter config; and its kind.

    Runs with neither adapter nor model are not runs yet and are left out.
    """
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    rolled = files.groupBy("run").agg(
        any_of(_at_root(X.ADAPTER_FILE)).alias("has_adapter"),
        any_of(F.col("rel_path").isin(*X.FULL_MODEL_FILES)).alias("has_model"),
        any_of(_at_root(X.ADAPTER_CONFIG_FILE)).alias("has_config"))
    found = rolled.where(F.col("has_adapter") | F.col("has_model"))
    return found.withColumn("kind", F.when(F.col("has_adapter"), "LoRA").otherwise("Full"))


def filter_runs(runs: DataFrame, methods: list[str] | None) -> DataFrame:
    """Runs whose lower-cased name contains any of the method names; no names keeps all."""
    if not methods:
        return runs
    name = F.lower(X.base_name(F.col("run")))
    return runs.where(F.exists(F.array(*[F.lit(m) for m in methods]), lambda m: F.contains(name, m)))


def parse_methods(text: str | None) -> list[str]:
    """Comma-separated method names of a text box; blank means all."""
    return [m.strip() for m in (text or "").split(",") if m.strip()]


def latest_adapter(files: DataFrame) -> DataFrame:
    """Newest usable adapter per run: at the root if there, else under the highest step.

    Checkpoints without the adapter file are passed over; an unreadable step is -1.
    """
    folder = F.regexp_extract("rel_path", r"^(checkpoint-[^/]*)/", 1)
    adapters = files.where(_at_root(X.ADAPTER_FILE) | (
        F.startswith("rel_path", F.lit(CHECKPOINT_PREFIX))
        & (F.regexp_replace("rel_path", r"^[^/]*/", "") == X.ADAPTER_FILE)))
    adapters = adapters.select(
        "run", F.nullif(folder, F.lit("")).alias("checkpoint"), X.checkpoint_step(folder).alias("step"))
    best = adapters.groupBy("run").agg(F.max_by(
        F.struct("checkpoint", "step"),
        F.struct(F.col("checkpoint").isNull(), F.col("step"), F.coalesce("checkpoint", F.lit("")))).alias("b"))
    return best.select(
        "run", F.col("b.checkpoint").alias("checkpoint"), F.col("b.step").alias("step"),
        X.adapter_label(X.base_name(F.col("run")), F.col("b.checkpoint")).alias("label"),
        F.concat_ws("/", "run", "b.checkpoint").alias("path"))


def last_checkpoint(files: DataFrame, order: str = "numeric") -> DataFrame:
    """Last checkpoint folder per run, by step or by the text of its name."""
    if order not in ("numeric", "name"):
        raise ValueError("order must be 'numeric' or 'name'")
    folder = F.regexp_extract("rel_path", r"^(checkpoint-[^/]*)/", 1)
    found = files.select("run", folder.alias("checkpoint")).where(F.col("checkpoint") != "")
    by = F.col("checkpoint")
    if order == "numeric":
        by = F.struct(X.checkpoint_step(F.col("checkpoint")), F.col("checkpoint"))
    return found.groupBy("run").agg(F.max_by("checkpoint", by).alias("checkpoint"))


def pick_state_file(files: DataFrame, order: str = "numeric") -> DataFrame:
    """The trainer state to read per run: the root's, else the last checkpoint's, else none.

    ``files`` may carry further columns (such as the text read); they stay on the row. One
    grouping finds the last checkpoint, the last one that has a state, and the root's state.
    """
    if order not in ("numeric", "name"):
        raise ValueError("order must be 'numeric' or 'name'")
    folder = F.nullif(F.regexp_extract("rel_path", r"^(checkpoint-[^/]*)/", 1), F.lit(""))
    step = X.checkpoint_step(folder) if order == "numeric" else F.lit(0)
    by = F.when(folder.isNotNull(), F.struct(step.alias("step"), folder.alias("name")))
    has_state = F.col("rel_path") == F.concat(folder, F.lit("/" + X.TRAINER_STATE_FILE))
    rest = [c for c in files.columns if c != "run"]
    row = F.struct(*rest)
    found = files.groupBy("run").agg(
        F.max(by).alias("last"), F.max(F.when(has_state, by)).alias("last_state"),
        F.max_by(row, F.when(has_state, by)).alias("below"),
        F.max_by(row, F.when(_at_root(X.TRAINER_STATE_FILE), F.lit(1))).alias("root"))
    best = F.coalesce("root", F.when(F.col("last") == F.col("last_state"), F.col("below")))
    return found.select("run", best.alias("b")).where("b is not null").select(
        "run", *[F.col(f"b.{c}").alias(c) for c in rest])


def with_base(inventory: DataFrame, base_model: str) -> DataFrame:
    """How to load each run: an adapter config means the base with the run laid over it."""
    overlay = F.col("has_config")
    return inventory.select(
        "*", F.when(overlay, "lora").otherwise("full").alias("load_as"),
        F.when(overlay, F.lit(base_model)).otherwise(F.col("run")).alias("model"),
        F.when(overlay, F.col("run")).alias("adapter"))


def resolve_models(requests: DataFrame, catalogue: DataFrame, model_dir: str,
                   key: list[str], request: str = "request") -> DataFrame:
    """Adds ``resolved``: the path asked for if the catalogue has it, else ``model_dir/name``.

    Blank asks for ``base``; null in ``resolved`` means there is neither.
    """
    asked = F.coalesce(F.nullif(X.strip(F.coalesce(request, F.lit(""))), F.lit("")), F.lit(DEFAULT_BASE))
    wanted = requests.withColumn("_given", asked).withColumn(
        "_under", F.concat(F.lit(model_dir.rstrip("/") + "/"), F.col("_given")))
    known = catalogue.select("path").distinct()
    as_given = known.select(F.col("path").alias("_given"), F.col("path").alias("_hit_given"))
    as_under = known.select(F.col("path").alias("_under"), F.col("path").alias("_hit_under"))
    joined = salted_join(wanted, as_given, ["_given"], key)
    joined = salted_join(joined, as_under, ["_under"], key, hot_from=wanted)
    return joined.select(*requests.columns, F.coalesce("_hit_given", "_hit_under").alias("resolved"))


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("resolved").isNull())


def label_paths(choices: DataFrame, adapters: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """Adds ``path`` of the chosen label; the base-only entry and unknown labels give ``''``."""
    by_label = adapters.groupBy(F.col("label").alias(label)).agg(F.max_by("path", "path").alias("path"))
    joined = salted_join(choices, by_label, [label], key)
    return joined.withColumn("path", F.coalesce("path", F.lit("")))


def label_list(adapters: DataFrame) -> DataFrame:
    """Labels and paths to choose from, the base-only entry (path ``''``) first."""
    spark = adapters.sparkSession
    base = spark.createDataFrame([(0, BASE_ONLY_LABEL, "")], "ord int, label string, path string")
    listed = adapters.select(F.lit(1).alias("ord"), "label", "path")
    return base.unionByName(listed).orderBy("ord", "label").select("label", "path")


def catalogue_counts(files: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """How many runs were found, how many pass the filter, how many adapters there are."""
    runs = run_inventory(files)
    count = lambda what, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return (count("runs", runs).unionByName(count("filtered", filter_runs(runs, methods)))
            .unionByName(count("adapters", latest_adapter(files))))
