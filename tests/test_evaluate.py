import io
import json
import math
from collections import Counter
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.functions.vectors import cosine
from prefloom.operators import catalog, leaderboard, metrics, ngram, rewards, scoring
from prefloom.plans import evaluate, registry
from prefloom.plans.rewards import score_rewards
from prefloom.sources import readers, sinks, states

# Published perplexity, test loss and seconds of five short runs.
GOLDEN = {
    "quick_dpo": (9.718826155354956, 2.274064845269574, 148.224),
    "quick_grpo": (9.74813630326765, 2.27707611835577, 8751.9164),
    "quick_kto": (9.778907251313079, 2.280227744809557, 107.4607),
    "quick_orpo": (9.712496921333784, 2.273413398713925, 28.5546),
    "quick_sft": (9.749599331346348, 2.2772261899444777, 202.0299),
}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(k, k, f"runs\\{k}", p, t, s, s / 3600, 3) for k, (p, t, s) in GOLDEN.items()]
    return spark.createDataFrame(
        rows, "run string, model_name string, model_path string, perplexity double, test_loss double, "
              "training_time_seconds double, training_time_hours double, total_steps bigint")


def test_golden_perplexity_and_hours(spark, golden):
    losses = golden.select("run", F.col("test_loss").alias("loss"), F.lit(10).alias("num_tokens"))
    for r in metrics.loss_metrics(losses).collect():
        assert r.perplexity == pytest.approx(GOLDEN[r.run][0], rel=1e-12)
    states = golden.select("run", F.lit(3).alias("global_step"), F.lit(None).cast("string").alias("best_model_checkpoint"))
    logs = golden.select("run", F.lit(0).alias("pos"), F.lit(None).cast("double").alias("loss"),
                         F.lit(None).cast("double").alias("eval_loss"), F.col("training_time_seconds").alias("train_runtime"))
    for r in metrics.training_metrics(logs, states).collect():
        assert r.training_time_hours == pytest.approx(GOLDEN[r.run][2] / 3600)
        assert r.total_steps == 3 and r.initial_train_loss is None and r.best_eval_loss is None


def test_golden_order(spark, golden):
    names = lambda kind: [r.model_name for r in leaderboard.leaderboard(golden, kind).collect()]
    assert names("a") == ["quick_kto", "quick_sft", "quick_grpo", "quick_dpo", "quick_orpo"]
    assert names("a_best_first") == names("a")[::-1]
    assert names("b") == sorted(GOLDEN)
    assert leaderboard.leaderboard(golden, "b").columns == leaderboard.LONG


@pytest.mark.parametrize("layout", ["lines", "object"])
def test_results_roundtrip(spark, golden, tmp_path, layout):
    path = str(tmp_path / layout)
    samples = F.array(F.struct(F.lit("q").alias("prompt"), F.lit("r\n").alias("response")))
    full = golden.withColumn("best_eval_loss", F.lit(None).cast("double")).withColumn("generation_samples", samples)
    sinks.write_results(full, path, layout)
    lines = [r.value for r in spark.read.text(path).collect()]
    if layout == "object":
        parts = sorted((tmp_path / layout).glob("part-*"))
        raw = json.loads("".join(p.read_text() for p in parts))
    else:
        raw = json.loads(sorted(lines)[0])
    assert raw["quick_dpo"]["best_eval_loss"] is None
    assert len(raw) == (5 if layout == "object" else 1)
    back, message = readers.read_results(spark, path, layout)
    assert "(5 entries)" in message
    got = {r.run: (r.perplexity, r.test_loss, r.training_time_seconds) for r in back.collect()}
    assert got == GOLDEN
    assert leaderboard.samples_of(back, "quick_kto").first().generation_samples[0].response == "r\n"
    assert leaderboard.samples_of(back.withColumn("generation_samples", F.lit(None).cast(
        "array<struct<prompt string, response string>>")), "quick_kto").first().generation_samples == []


def test_results_problems_are_messages(spark, golden, tmp_path):
    assert readers.read_results(spark, str(tmp_path / "none"))[0] is None
    (tmp_path / "bad.json").write_text("{ nope")
    frame, message = readers.read_results(spark, str(tmp_path / "bad.json"))
    assert frame is None and "could not read" in message
    (tmp_path / "whole.json").write_text(json.dumps({"a": {"perplexity": 2.0}, "b": {"perplexity": 3.0}}, indent=2))
    back, message = readers.read_results(spark, str(tmp_path / "whole.json"))
    assert "(2 entries)" in message and {r.run: r.perplexity for r in back.collect()} == {"a": 2.0, "b": 3.0}
    with pytest.raises(ValueError):
        readers.read_results(spark, str(tmp_path / "whole.json"), "rows")


def test_training_log_quirks(spark):
    logs = spark.createDataFrame([
        ("a", 0, 2.0, None, None), ("a", 1, 1.5, 9.0, None), ("a", 2, 0.0, None, 60.0), ("a", 3, None, 8.0, None),
        ("b", 0, None, 3.0, None), ("b", 1, None, None, 7200.0),
    ], "run string, pos int, loss double, eval_loss double, train_runtime double")
    states = spark.createDataFrame([("a", 10, "c"), ("b", None, None), ("c", 1, None)],
                                   "run string, global_step bigint, best_model_checkpoint string")
    got = {r.run: r for r in metrics.training_metrics(logs, states).collect()}
    assert (got["a"].initial_train_loss, got["a"].final_train_loss) == (2.0, 0.0)
    assert (got["a"].best_eval_loss, got["a"].final_eval_loss, got["a"].training_time_seconds) == (8.0, 8.0, 0.0)
    assert (got["b"].total_steps, got["b"].training_time_hours, got["b"].initial_train_loss) == (0, 2.0, None)
    assert (got["c"].training_time_seconds, got["c"].best_eval_loss) == (0.0, None)


def test_preference_metrics_ties_are_wrong(spark):
    losses = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 1.0)], "run string, chosen_loss double, rejected_loss double")
    row = metrics.preference_metrics(losses).first()
    assert (row.preference_correct, row.preference_total) == (1, 3)
    assert row.preference_accuracy * row.preference_total == pytest.approx(row.preference_correct)
    assert row.loss_margin == pytest.approx(5 / 3 - 2)
    assert metrics.preference_metrics(losses.limit(0)).count() == 0


def test_loss_metrics_without_tokens_and_repartitioned(spark):
    losses = spark.createDataFrame([("a", 2.0, 3), ("a", 4.0, 1), ("z", 1.0, 0)], "run string, loss double, num_tokens bigint")
    for df in (losses, losses.repartition(7)):
        got = {r.run: (r.test_loss, r.perplexity) for r in metrics.loss_metrics(df).collect()}
        assert got == {"a": (2.5, pytest.approx(math.exp(2.5))), "z": (0.0, 1.0)}


def test_merge_later_values_win(spark):
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run string, x int")
    part = spark.createDataFrame([("a", 9, 5)], "run string, x int, y int")
    got = {r.run: (r.x, r.y) for r in metrics.merge_metrics(runs, part).collect()}
    assert got == {"a": (9, 5), "b": (2, None)}


def test_summary_shows_zero_as_na(spark):
    df = spark.createDataFrame([("b", 0.0, 3.14159, 0.655), ("a", 1.23456, None, 0.0)],
                               "run string, best_eval_loss double, perplexity double, preference_accuracy double")
    assert [tuple(r) for r in metrics.summary_lines(df).collect()] == [
        ("a", "1.2346", "N/A", "N/A"), ("b", "N/A", "3.14", "65.50%")]


def test_metrics_by_group_in_one_pass(spark):
    losses = spark.createDataFrame(
        [("a", "x", 1.0, 2.0), ("a", "y", 3.0, 2.0), ("a", "y", 1.0, 4.0), ("b", "x", 2.0, 2.0), ("b", None, 1.0, 5.0)],
        "run string, source string, chosen_loss double, rejected_loss double")
    got = {(r.grouping, r.run, r.source): (r.preference_correct, r.preference_total) for r in
           metrics.preference_by_group(losses, "source").collect()}
    assert got == {(0, "a", "x"): (1, 1), (0, "a", "y"): (1, 2), (0, "b", "x"): (0, 1), (0, "b", None): (1, 1),
                   (1, "a", None): (2, 3), (1, "b", None): (1, 2), (3, None, None): (3, 5)}
    by_run = {r.run: r for r in metrics.preference_metrics(losses).collect()}
    alike = {r.run: r for r in metrics.preference_by_group(losses, "source").where("grouping = 1").collect()}
    assert all(by_run[k].loss_margin == alike[k].loss_margin and by_run[k].preference_accuracy == alike[k].preference_accuracy for k in by_run)


def test_nested_samples_keep_order_and_cap(spark):
    df = spark.createDataFrame([("a", i, f"p{i}", f"r{i}") for i in (4, 2, 0, 1, 3)], "run string, pos int, prompt string, response string")
    assert [s.prompt for s in metrics.nest_samples(df, 3).first().generation_samples] == ["p0", "p1", "p2"]


# --------------------------------------------------------------------- runs

@pytest.fixture()
def runs_dir(tmp_path):
    root = tmp_path / "runs"
    state = lambda n: json.dumps({"global_step": n, "best_model_checkpoint": None, "log_history": [
        {"loss": 2.0, "step": 1}, {"eval_loss": 1.5, "step": 2}, {"train_runtime": 36.0, "step": n}]})
    files = {
        "sft_a/adapter_model.safetensors": "x", "sft_a/adapter_config.json": "{}", "sft_a/trainer_state.json": state(3),
        "sft_a/checkpoint-9/adapter_model.safetensors": "x",
        "DPO_b/model.safetensors": "x", "DPO_b/checkpoint-500/trainer_state.json": state(500),
        "DPO_b/checkpoint-1000/trainer_state.json": state(1000), "DPO_b/checkpoint-500/adapter_model.safetensors": "x",
        "DPO_b/checkpoint-x/adapter_model.safetensors": "x",
        "kto_c/notes.txt": "x", "kto_c/deep/checkpoint-5/adapter_model.safetensors": "x", "stray.txt": "x",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_run_folders(spark, runs_dir):
    files = readers.run_files(spark, runs_dir)
    assert files.count() == 11
    inventory = {r.run: r for r in catalog.with_base(catalog.run_inventory(files), "base").collect()}
    assert {k: v.kind for k, v in inventory.items()} == {"sft_a": "LoRA", "DPO_b": "Full"}
    assert (inventory["sft_a"].model, inventory["sft_a"].adapter) == ("base", "sft_a")
    assert (inventory["DPO_b"].load_as, inventory["DPO_b"].model) == ("full", "DPO_b")
    found = catalog.run_inventory(files)
    assert [r.run for r in catalog.filter_runs(found, catalog.parse_methods("dpo,")).collect()] == ["DPO_b"]
    assert catalog.filter_runs(found, catalog.parse_methods(" , ")).count() == 2
    newest = {r.run: (r.label, r.path) for r in catalog.latest_adapter(files).collect()}
    assert newest == {"sft_a": ("sft_a", "sft_a"), "DPO_b": ("DPO_b/checkpoint-500", "DPO_b/checkpoint-500")}
    assert [r.label for r in catalog.label_list(catalog.latest_adapter(files)).collect()] == [
        "(仅基座模型)", "DPO_b/checkpoint-500", "sft_a"]
    counts = {r.what: r.n for r in catalog.catalogue_counts(files, ["sft"]).collect()}
    assert counts == {"runs": 2, "filtered": 1, "adapters": 2}
    assert readers.run_files(spark, runs_dir + "_none").count() == 0


def test_trainer_states(spark, runs_dir):
    steps = lambda order: {r.run: r.global_step for r in readers.trainer_states(spark, runs_dir, order).collect()}
    assert steps("numeric") == {"sft_a": 3, "DPO_b": 1000}
    files = readers.run_files(spark, runs_dir)
    by_name = {r.run: r.checkpoint for r in catalog.last_checkpoint(files, "name").collect()}
    assert by_name["DPO_b"] == "checkpoint-x"
    states = readers.trainer_states(spark, runs_dir)
    got = {r.run: r for r in metrics.training_metrics(metrics.log_rows(states), states).collect()}
    assert (got["sft_a"].final_train_loss, got["sft_a"].best_eval_loss, got["sft_a"].training_time_hours) == (2.0, 1.5, 0.01)


def test_only_the_state_that_counts_is_opened(spark, runs_dir):
    root = Path(runs_dir)
    odd = root / "odd [a]{b}*\\?" / "checkpoint-7"
    odd.mkdir(parents=True)
    (odd / "trainer_state.json").write_text(json.dumps({"global_step": 7}))
    (root / "odd a" / "checkpoint-8").mkdir(parents=True)
    (root / "odd a" / "checkpoint-8" / "notes.txt").write_text("last, and has no state")
    (root / "odd a" / "checkpoint-2").mkdir()
    (root / "odd a" / "checkpoint-2" / "trainer_state.json").write_text("{}")
    states = readers.trainer_states(spark, runs_dir)
    assert {r.run: r.global_step for r in states.collect()} == {"sft_a": 3, "DPO_b": 1000, odd.parent.name: 7}
    opened = {unquote(p).split("runs/", 1)[1] for p in states.inputFiles()}
    assert opened == {"sft_a/trainer_state.json", "DPO_b/checkpoint-1000/trainer_state.json",
                      f"{odd.parent.name}/checkpoint-7/trainer_state.json"}
    plan = readers.run_files(spark, runs_dir)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]


def test_folder_of_runs_to_published_results(spark, runs_dir, tmp_path):
    train = spark.createDataFrame([("sft_a", "a b a"), ("DPO_b", "a c"), ("elsewhere", "q")], "run string, text string")
    turn = lambda text: [("user", "q"), ("assistant", text)]
    chats = spark.createDataFrame([(1, turn("a b")), (2, turn("c"))], "id int, messages array<struct<role:string,content:string>>")
    prefs = spark.createDataFrame([(1, turn("a a"), turn("z"))], "id int, chosen array<struct<role:string,content:string>>, "
                                  "rejected array<struct<role:string,content:string>>")
    model = ngram.fit_ngram(train).stored()
    base, out = ngram.pool(model).stored(), str(tmp_path / "results")
    got = {r.run: r for r in evaluate.evaluate_runs(spark, runs_dir, out, ["id"], model, base, test=chats, prefs=prefs).collect()}
    assert set(got) == {"sft_a", "DPO_b"}
    sft, dpo = got["sft_a"], got["DPO_b"]
    assert (sft.model_name, sft.model_path, sft.total_steps, sft.training_time_hours) == ("sft_a", f"{runs_dir}/sft_a", 3, 0.01)
    assert dpo.total_steps == 1000 and dpo.generation_samples is None
    texts = evaluate.test_texts(chats, ["id"])
    over = {r.run: r.test_loss for r in ngram.corpus_loss(texts, ngram.MixedModel(base, model)).collect()}
    alone = {r.run: r.test_loss for r in ngram.corpus_loss(texts, model).collect()}
    assert sft.test_loss == pytest.approx(over["sft_a"]) and dpo.test_loss == pytest.approx(alone["DPO_b"])
    assert sft.test_loss != pytest.approx(alone["sft_a"]) and sft.preference_total == dpo.preference_total == 1
    only = evaluate.evaluate_runs(spark, runs_dir, out, ["id"], model, methods=["dpo"], test=chats)
    assert [r.run for r in only.collect()] == ["DPO_b"]
    text = "".join(p.read_text() for p in sorted(Path(sinks.published(spark, out)).glob("part-*")))
    assert list(json.loads(text)) == ["DPO_b"]
    for none in (runs_dir + "_none", runs_dir):
        assert evaluate.evaluate_runs(spark, none, out, ["id"], model, methods=["nothing"]) is None
    assert readers.read_results(spark, sinks.published(spark, out), "object")[1].endswith("(1 entries)")


def test_model_and_label_lookup(spark):
    known = spark.createDataFrame([("models/base",), ("models/m",), ("/abs/m",)], "path string")
    asked = spark.createDataFrame([(1, " "), (2, None), (3, "m"), (4, "/abs/m"), (5, "zzz")], "id int, request string")
    out = catalog.resolve_models(asked, known, "models/", ["id"])
    assert {r.id: r.resolved for r in out.collect()} == {
        1: "models/base", 2: "models/base", 3: "models/m", 4: "/abs/m", 5: None}
    assert [r.id for r in catalog.unresolved(out).collect()] == [5]
    adapters = spark.createDataFrame([("a", "runs/a")], "label string, path string")
    choices = spark.createDataFrame([(1, "a"), (2, "(仅基座模型)"), (3, "gone")], "id int, label string")
    assert {r.id: r.path for r in catalog.label_paths(choices, adapters, ["id"]).collect()} == {1: "runs/a", 2: "", 3: ""}


# -------------------------------------------------------------- word models

TRAIN = [("en", "the cat sat on the mat"), ("en", "the dog sat"), ("fr", "le chat sur le tapis"), ("fr", ""), (None, "skip me")]
TEST = [(1, "the cat sat"), (2, "le chien"), (3, "zzz zzz"), (4, ""), (5, "the the the the cat")]


def brute_force(order, lam=0.5):
    losses = {}
    for run in ("en", "fr"):
        docs = [t.split() for r, t in TRAIN if r == run]
        uni = Counter(w for d in docs for w in d)
        big = Counter(p for d in docs for p in zip(d, d[1:]))
        ctx = Counter(a for d in docs for a in d[:-1])
        n, v = sum(uni.values()), len(uni)
        p1 = lambda w: (uni[w] + 1) / (n + v + 1)
        for i, text in TEST:
            w = text.split()
            if order == 1:
                terms = [-math.log(p1(x)) for x in w]
            else:
                terms = [-math.log(lam * (big[a, b] / ctx[a] if ctx[a] else 0) + (1 - lam) * p1(b)) for a, b in zip(w, w[1:])]
            if terms:
                losses[i, run] = (sum(terms) / len(terms), len(w))
    return losses


def frames_of(spark):
    return (spark.createDataFrame(TRAIN, "run string, text string"),
            spark.createDataFrame(TEST, "id int, text string"))


@pytest.mark.parametrize("order", [1, 2])
def test_sequence_loss_by_hand(spark, order):
    train, test = frames_of(spark)
    got = ngram.sequence_loss(test, ngram.fit_ngram(train, order=order), ["id"])
    want = brute_force(order)
    rows = {(r.id, r.run): (r.loss, r.num_tokens) for r in got.collect()}
    assert rows.keys() == want.keys()
    for k, (loss, n) in want.items():
        assert rows[k] == (pytest.approx(loss, abs=1e-12), n)


@pytest.mark.parametrize("order", [1, 2])
def test_own_run_and_chosen_runs(spark, order):
    train, test = frames_of(spark)
    model = ngram.fit_ngram(train, order=order)
    want = brute_force(order)
    own = ngram.sequence_loss(test.withColumn("lang", F.when(F.col("id") == 2, "fr").otherwise("en")), model, ["id"], own_run="lang")
    got = {(r.id, r.run): r.loss for r in own.collect()}
    assert got == {k: pytest.approx(v[0]) for k, v in want.items() if k[1] == ("fr" if k[0] == 2 else "en")}
    some = ngram.sequence_loss(test, model, ["id"], runs=["fr"])
    assert {(r.id, r.run): r.loss for r in some.collect()} == {k: pytest.approx(v[0]) for k, v in want.items() if k[1] == "fr"}


def test_probabilities_sum_to_one(spark):
    model = ngram.fit_ngram(frames_of(spark)[0])
    p = model.words.join(model.totals, "run").groupBy("run").agg(
        F.sum((F.col("c") + 1) / (F.col("n") + F.col("v") + 1)).alias("s"), F.first(1 / (F.col("n") + F.col("v") + 1)).alias("unseen"))
    for r in p.collect():
        assert r.s + r.unseen == pytest.approx(1.0)


def test_corpus_loss_equals_weighted_samples(spark):
    train, test = frames_of(spark)
    model = ngram.fit_ngram(train)
    by_sample = {r.run: r.test_loss for r in metrics.loss_metrics(ngram.sequence_loss(test, model, ["id"])).collect()}
    at_once = {r.run: r.test_loss for r in ngram.corpus_loss(test, model).collect()}
    assert at_once == {k: pytest.approx(v) for k, v in by_sample.items()}
    empty = ngram.corpus_loss(test.where("id = 4"), model).collect()
    assert {r.test_loss for r in empty} == {0.0} and len(empty) == 2


def test_mixed_model(spark):
    train, test = frames_of(spark)
    base = ngram.fit_ngram(train.withColumn("run", F.lit("base")).where("text <> 'skip me'"))
    model = ngram.fit_ngram(train)
    all_adapter = {(r.id, r.run): r.loss for r in ngram.sequence_loss(test, ngram.MixedModel(base, model, 1.0), ["id"]).collect()}
    assert all_adapter == {k: pytest.approx(v[0]) for k, v in brute_force(1).items()}
    mixed = {(r.run, r.token): r.p for r in ngram.mix(ngram.MixedModel(base, model, 0.25)).collect()}
    words = Counter(w for r, t in TRAIN if r for w in t.split())
    n, v = sum(words.values()), len(words)
    assert mixed["fr", "the"] == pytest.approx(0.75 * 4 / (n + v + 1) + 0.25 * 1 / (5 + 4 + 1))
    model = ngram.MixedModel(base, model, 0.25)
    every = {(r.id, r.run): (r.loss, r.num_tokens) for r in ngram.sequence_loss(test, model, ["id"]).collect()}
    own = ngram.sequence_loss(test.withColumn("r", F.lit("en")), model, ["id"], own_run="r").collect()
    assert {(r.id, r.run): (pytest.approx(r.loss), r.num_tokens) for r in own} == {k: v for k, v in every.items() if k[1] == "en"}
    size = {run: (sum(c.values()), len(c)) for run in ("en", "fr")
            for c in [Counter(w for r, t in TRAIN if r == run for w in t.split())]}
    unseen = {run: 0.75 / (n + v + 1) + 0.25 / (sum(size[run]) + 1) for run in size}
    sums = {run: [0.0, 0] for run in size}
    for i, text in TEST:
        for run in size:
            terms = [-math.log(mixed.get((run, w), unseen[run])) for w in text.split()]
            assert not terms or every[i, run] == (pytest.approx(sum(terms) / len(terms), abs=1e-12), len(terms))
            sums[run] = [sums[run][0] + sum(terms), sums[run][1] + len(terms)]
    at_once = {r.run: (r.test_loss, r.num_tokens) for r in ngram.corpus_loss(test, model).collect()}
    assert at_once == {run: (pytest.approx(loss / k), k) for run, (loss, k) in sums.items()}
    empty = ngram.corpus_loss(test.where("id = 4"), model).collect()
    assert {r.test_loss for r in empty} == {0.0} and len(empty) == 2


def test_token_limit_and_saved_model(spark, tmp_path):
    train, test = frames_of(spark)
    model = ngram.fit_ngram(train, order=2)
    model.save(str(tmp_path / "m"))
    loaded = ngram.NgramModel.load(spark, str(tmp_path / "m"), 2)
    assert sorted(r.run for r in loaded.runs().collect()) == ["en", "fr"]
    cut = ngram.sequence_loss(test, loaded, ["id"], max_tokens=2).collect()
    assert {r.num_tokens for r in cut} == {2}


def test_scoring_is_whole_under_hot_words(spark, monkeypatch):
    import prefloom.operators.skew as skew
    plain = skew.salted_join
    monkeypatch.setattr(ngram, "salted_join", lambda *a, **k: plain(*a, **{**k, "hot_rows": 2}))
    train, test = frames_of(spark)
    for order in (1, 2):
        got = ngram.sequence_loss(test, ngram.fit_ngram(train, order=order), ["id"])
        assert {(r.id, r.run): r.loss for r in got.collect()} == {k: pytest.approx(v[0]) for k, v in brute_force(order).items()}


def test_runs_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram, "RUN_BLOCK", 3)
    train = spark.range(40).select(F.format_string("r%d", "id").alias("run"), F.format_string("w%d the", F.col("id") % 5).alias("text"))
    test = frames_of(spark)[1]
    got = ngram.sequence_loss(test, ngram.fit_ngram(train), ["id"]).collect()
    texts = {i: t.split() for i, t in TEST if t.split()}
    assert len(got) == 40 * len(texts) and len({(r.id, r.run) for r in got}) == len(got)
    for r in got:
        want = [-math.log((2 if w in ("the", f"w{int(r.run[1:]) % 5}") else 1) / 5) for w in texts[r.id]]
        assert r.loss == pytest.approx(sum(want) / len(want))


@pytest.mark.parametrize("order", [1, 2])
def test_preference_rollup_equals_losses(spark, order):
    model = ngram.fit_ngram(frames_of(spark)[0], order=order)
    prefs = spark.createDataFrame(
        [(1, "the cat", "le chat"), (2, "the cat sat", "sat the cat the"), (3, "zzz yyy", "xxx www"), (4, "the cat", "the cat"),
         (5, "", "the cat"), (6, None, "the cat"), (7, "le chat", "the cat zzz")], "id int, chosen string, rejected string")
    want = {r.run: r for r in metrics.preference_metrics(ngram.preference_losses(prefs, model, ["id"])).collect()}
    got = {r.run: r for r in ngram.preference_rollup(prefs, model, ["id"]).collect()}
    assert got.keys() == want.keys() and len(got) == 2
    for run, row in got.items():
        assert row.asDict() == {k: pytest.approx(v) for k, v in want[run].asDict().items()}
    assert ngram.preference_rollup(prefs.where("id > 4 and id < 7"), model, ["id"]).count() == 0


def test_runs_choose_overlay_or_own_model(spark):
    train, test = frames_of(spark)
    model = ngram.fit_ngram(train)
    base = ngram.pool(model)
    runs = spark.createDataFrame([("en", "lora"), ("fr", "full")], "run string, load_as string")
    chats = test.select("id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    prefs = spark.createDataFrame([(1, "the cat", "le chat"), (2, "the dog", "zzz zzz")], "id int, chosen string, rejected string")
    rows = {r.run: r for r in evaluate.evaluate(runs, ["id"], model, chats, prefs, base=base).collect()}
    alone = {r.run: r for r in evaluate.evaluate(runs, ["id"], model, chats, prefs).collect()}
    over = {r.run: r for r in evaluate.evaluate(runs, ["id"], ngram.MixedModel(base, model), chats, prefs).collect()}
    same = lambda a, b: a.asDict() == {k: pytest.approx(v) for k, v in b.asDict().items()}
    assert same(rows["en"], over["en"]) and same(rows["fr"], alone["fr"]) and not same(rows["en"], alone["en"])


def test_evaluate_parts_have_their_own_switch(spark):
    train, test = frames_of(spark)
    runs = spark.createDataFrame([("en",), ("fr",), ("new",)], "run string")
    chats = test.select("id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    prefs = spark.createDataFrame([(1, "the cat", "le chat"), (2, "", "x"), (3, "the dog", "zzz zzz")], "id int, chosen string, rejected string")
    out = evaluate.evaluate(runs, ["id"], ngram.fit_ngram(train), chats, prefs)
    got = {r.run: r for r in out.collect()}
    assert got["new"].perplexity is None and got["new"].preference_accuracy is None
    assert (got["en"].preference_total, got["en"].preference_accuracy) == (2, 1.0)
    assert got["fr"].perplexity == pytest.approx(math.exp(got["fr"].test_loss))
    only = evaluate.evaluate(runs, ["id"], ngram.fit_ngram(train), prefs=prefs, max_samples=1)
    assert {r.preference_total for r in only.collect()} == {1, None} and "perplexity" not in only.columns
    assert evaluate.evaluate(runs, ["id"]).columns == ["run"]
    registry.add_metric("size", lambda df: df.groupBy("run").agg(F.count("text").alias("texts")))
    sized = evaluate.evaluate(runs, ["id"], extra={"size": train.where("run is not null")})
    registry.METRICS.pop("size")
    assert {r.run: r.texts for r in sized.collect()} == {"en": 2, "fr": 2, "new": None}


def test_no_python_and_no_product_in_scoring_plan(spark):
    train, test = frames_of(spark)
    plan = ngram.sequence_loss(test, ngram.fit_ngram(train, order=2), ["id"])._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Window"):
        assert word not in plan


# ------------------------------------------------------------------ rewards

def vectors(spark, n=24):
    rng = np.random.default_rng(0)
    rows = [(i, i // 8, *[[float(x) for x in rng.normal(size=4)] for _ in range(3)], float(i % 5), float(i % 3)) for i in range(n)]
    rows.append((n, 99, [0.0] * 4, [1.0] * 4, [1.0] * 4, None, 1.0))
    return spark.createDataFrame(
        rows, "id int, g int, y array<double>, chosen array<double>, rejected array<double>, score_chosen double, score_rejected double")


NAMES = {"completion": "y", "chosen": "chosen", "rejected": "rejected", "score_chosen": "score_chosen", "score_rejected": "score_rejected"}


def test_similarity_reward_and_groups(spark):
    df = vectors(spark)
    scored, best = score_rewards(df, rewards.similarity_reward, NAMES, "g", "id")
    rows = scored.collect()

    def cos(a, b):
        return float(np.dot(a, b) / (max(np.linalg.norm(a), 1e-8) * max(np.linalg.norm(b), 1e-8)))

    for r in rows:
        assert r.reward == pytest.approx(2 * ((r.score_chosen or 0) * cos(r.y, r.chosen) - r.score_rejected * cos(r.y, r.rejected)))
    for g in {r.g for r in rows}:
        group = [r for r in rows if r.g == g]
        values = [r.reward for r in group]
        sd = np.std(values, ddof=1) if len(values) > 1 else 0.0
        for r in group:
            assert r.advantage == pytest.approx((r.reward - np.mean(values)) / (sd + 1e-4), abs=1e-9)
    winners = {r.g: r.id for r in best.collect()}
    assert winners == {g: min((-r.reward, r.id) for r in rows if r.g == g)[1] for g in {r.g for r in rows}}


def test_best_of_group_tie_takes_lowest_key(spark):
    df = spark.createDataFrame([(3, 0, 1.0), (1, 0, 1.0), (2, 0, 0.5)], "id int, g int, reward double")
    assert rewards.best_of_group(df, "g", "id").first().id == 1


def test_mean_pool_and_char_reward(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [0.0, 0.0])], "k string, v array<float>")
    assert {r.k: r.embedding for r in rewards.mean_pool(df, ["k"], "v").collect()} == {"a": [2.0, 4.0], "b": [0.0, 0.0]}
    texts = spark.createDataFrame([("aab",), ("",)], "t string")
    got = rewards.apply_reward(texts, lambda completion: rewards.distinct_char_reward(completion), {"completion": "t"})
    assert [r.reward for r in got.collect()] == [2.0, 0.0]
    zero = rewards.zero_score_share(spark.createDataFrame([(None, 0.0), (1.0, 0.0)], "score_chosen double, score_rejected double"))
    assert zero.first().zero_share == 0.5


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b")).alias("c")).first().c == 0.0


def test_own_scorer_and_row_function(spark):
    def make():
        return lambda x: x * 2.0

    df = spark.createDataFrame([(1, 1.5), (2, 4.0)], "id int, x double")
    assert {r.id: r.score for r in scoring.batch_score(df, make, ["x"]).collect()} == {1: 3.0, 2: 8.0}
    mapped = scoring.map_rows(df, lambda r: {"y": r["x"] + r["id"]}, "id int, y double", ["x"])
    assert {r.id: r.y for r in mapped.collect()} == {1: 2.5, 2: 6.0}


def test_row_functions_keep_whole_numbers(spark):
    df = spark.createDataFrame([(9007199254740993, "a b"), (None, "c")], "n bigint, text string")
    out = scoring.map_rows(df, lambda r: {"words": len(r["text"].split())}, "n bigint, words bigint", ["text"])
    assert {(r.n, r.words) for r in out.collect()} == {(9007199254740993, 2), (None, 1)}


def test_runs_are_named_below_the_root_whatever_its_name(spark, tmp_path):
    root = tmp_path / "runs" / "exp" / "runs"
    for run, step in (("my run", 3), ("r1", 5)):
        folder = root / run / "checkpoint-10"
        folder.mkdir(parents=True)
        (folder / "trainer_state.json").write_text(json.dumps({"global_step": step}))
        (folder / "adapter_model.safetensors").write_text("w")
    for asked in (str(root), str(root) + "/", str(root) + "/."):
        assert {(r.run, r.rel_path) for r in readers.run_files(spark, asked).collect()} == {
            (run, f"checkpoint-10/{name}") for run in ("my run", "r1") for name in ("trainer_state.json", "adapter_model.safetensors")}
        assert {r.run: r.global_step for r in readers.trainer_states(spark, asked).collect()} == {"my run": 3, "r1": 5}
    assert readers.trainer_states(spark, str(root) + "_none").count() == 0


def test_rows_that_are_not_scored_have_a_reason(spark):
    chats = "array<struct<role string, content string>>"
    turn = lambda text: [("user", "q"), ("assistant", text)]
    test = spark.createDataFrame([(1, turn("a")), (2, turn(None)), (3, None), (4, []), (None, [(None, "x")])], f"id int, messages {chats}")
    assert {(r.id, r.reject_reason) for r in evaluate.test_rejects(test, ["id"]).collect()} == {
        (2, "broken_message"), (3, "no_text"), (None, "broken_message")}
    assert sorted(r.id for r in evaluate.test_texts(test, ["id"]).collect()) == [1, 4]
    pairs = spark.createDataFrame([
        (1, turn("a"), turn("b")), (2, turn(None), turn("b")), (3, turn("a"), []), (4, None, turn(None)), (5, turn("a"), turn(None))],
        f"id int, chosen {chats}, rejected {chats}")
    assert {(r.id, r.reject_reason) for r in evaluate.pair_rejects(pairs, ["id"]).collect()} == {
        (2, "broken_message"), (3, "empty_side"), (4, "empty_side"), (5, "broken_message")}
    plain = spark.createDataFrame([(1, "a", "b"), (2, "", "b"), (3, None, "b")], "id int, chosen string, rejected string")
    assert {(r.part, r.reject_reason): r.n for r in evaluate.reject_counts(test, plain).collect()} == {
        ("test", "broken_message"): 2, ("test", "no_text"): 1, ("pairs", "empty_side"): 2}
    assert evaluate.reject_counts(test.limit(0), pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        evaluate.reject_counts()


def test_many_files_are_listed_and_read_by_tasks(spark, runs_dir, monkeypatch):
    root = Path(runs_dir)
    odd = root / "odd [a]{b}* %20é" / "checkpoint-7"
    odd.mkdir(parents=True)
    (odd / "trainer_state.json").write_text(json.dumps({"global_step": 7}))
    (odd / "empty.txt").write_text("")
    for hidden in ("_tmp/a.txt", ".git/a.txt", "sft_a/_b/a.txt", "sft_a/.c", "sft_a/d._COPYING_"):
        (root / hidden).parent.mkdir(parents=True, exist_ok=True)
        (root / hidden).write_text("x")
    (root / "sft_a" / "_k=v").write_text("x")
    (root / "bare").mkdir()
    (root / "bad" / "checkpoint-1").mkdir(parents=True)
    (root / "bad" / "checkpoint-1" / "trainer_state.json").write_text("{ nope")
    row = lambda df: sorted((r.asDict(True) for r in df.collect()), key=str)
    files, states = row(readers.run_files(spark, runs_dir)), row(readers.trainer_states(spark, runs_dir))
    assert len(files) == 14 and len(states) == 4
    monkeypatch.setattr(readers, "LISTED_FILES", 5)
    for asked in (runs_dir, runs_dir + "/", f"file://{runs_dir}"):
        by_tasks = readers.run_files(spark, asked)
        assert by_tasks.inputFiles() == [] and row(by_tasks) == files
        assert row(readers.trainer_states(spark, asked)) == states
        assert row(readers.trainer_states(spark, asked, files=by_tasks)) == states
        assert readers.trainer_states(spark, asked).inputFiles() == []
    assert readers.trainer_states(spark, runs_dir + "_none").count() == 0


LOGGED = [
    {"loss": 2.5, "step": 1}, {"step": 2, "eval_loss": 9.0, "note": 'a ] } , " \\ \\" [ { é \u2028'}, None, {}, {"loss": 1, "step": "x"},
    {"loss": "none", "train_runtime": 1.0}, {"more": {"log_history": [1, {"a": [2, "]"]}]}, "loss": 0.5}, {"eval_loss": 0.25, "x": "\\\\"},
    {"loss": 4.0}, {"train_runtime": 7.5, "it's": "'"}]
STATES = {
    "plain": json.dumps({"global_step": 3, "log_history": LOGGED * 9, "best_model_checkpoint": "c"}),
    "wide": json.dumps({"a": {"b": ["log_history", [1, 2]]}, "global_step": 3, "log_history": LOGGED * 9, "z": [[1, 2], {"log_history": [5]}]},
                       indent=2, ensure_ascii=False),
    "escaped key": json.dumps({"global_step": 4, "log_history": LOGGED * 9}).replace('"log_history": [{"loss": 2.5', '"log_hist\\u006fry" :\n [{"loss": 2.5', 1),
    "two logs": json.dumps({"log_history": LOGGED * 9})[:-1] + ', "log_history": [{"loss": 1.0}]}',
    "log lost": json.dumps({"log_history": LOGGED * 9})[:-1] + ', "log_history": 7, "global_step": 8}',
    "numbers": json.dumps({"log_history": [*LOGGED, 5, *LOGGED], "global_step": 8}),
    "comma": json.dumps({"log_history": LOGGED * 9, "global_step": 8}).replace("}, {", "}, , {", 1),
    "last comma": json.dumps({"log_history": LOGGED * 9, "global_step": 8}).replace("}]", "},]"),
    "bad entry": json.dumps({"global_step": 8, "log_history": LOGGED * 9}).replace('"loss": 4.0', '"loss": 4.0.1', 5),
    "single quotes": "{'global_step': 8, 'log_history': [" + ", ".join(["{'loss': 1.0, 'x': ']'}"] * 40) + "]}",
    "in a list": json.dumps([{"global_step": 8, "log_history": LOGGED * 9}]),
    "no log": json.dumps({"global_step": 8, "other": [LOGGED] * 9}),
    "text after": json.dumps({"global_step": 8, "log_history": LOGGED * 9}) + " }] more",
    **{f"cut at {n}": json.dumps({"global_step": 5, "log_history": LOGGED * 9})[:-n] for n in (1, 2, 3, 4, 9, 20, 30, 40, 60, 300)},
}


def test_large_trainer_states_are_read_in_slices(spark, tmp_path, monkeypatch):
    for run, text in STATES.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "trainer_state.json").write_text(text)
    (tmp_path / "bytes").mkdir()
    (tmp_path / "bytes" / "trainer_state.json").write_bytes(
        b'{"global_step": 2, "log_history": [' + b", ".join([b'{"loss": 1.5, "x": "\xff\xc3"}'] * 40) + b"]}")
    root = str(tmp_path)
    row = lambda df: sorted((r.asDict(True) for r in df.collect()), key=str)

    def read():
        found = readers.trainer_states(spark, root)
        return found, row(metrics.log_rows(found)), row(metrics.training_metrics(metrics.log_rows(found), found))

    whole, logs, figures = read()
    assert whole.count() == len(figures) == len(STATES) + 1 and {r["run"] for r in logs} >= {"plain", "wide", "bytes", "escaped key"}
    monkeypatch.setattr(readers, "SLICE_BYTES", 150)
    for listed in (1_000, 5):  # read below the driver's listing, and by tasks alone
        monkeypatch.setattr(readers, "LISTED_FILES", listed)
        sliced, again, same = read()
        assert again == logs and same == figures
        cells = {r.run: r.n for r in sliced.groupBy("run").agg(F.max(F.size("log_history")).alias("n")).collect()}
        assert all(cells[run] < 20 for run in ("plain", "wide", "escaped key", "bytes"))
        assert sliced.where("run = 'plain'").count() > 9


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_slices_do_not_depend_on_the_chunks_read(chunk, monkeypatch):
    found = lambda: {run: states.log_slices(io.BytesIO(text.encode()), 150) for run, text in STATES.items()}
    at_once = found()
    monkeypatch.setattr(states, "CHUNK", chunk)
    assert found() == at_once
    assert {run for run, slices in at_once.items() if slices and slices.spans} == {"plain", "wide", "escaped key"}


def test_a_cut_state_is_found_without_holding_its_log():
    text = ('{"global_step": 1, "log_history": [' + ", ".join(['{"loss": 1.0, "t": "}],[{"}'] * 200_000) + '], "z": [1]}').encode()
    found = states.log_slices(io.BytesIO(text), 1 << 16)
    assert (found.head, found.tail) == (b'{"global_step": 1, "log_history": [', b'], "z": [1]}')
    sizes = [len(t) for _, t in found.texts(io.BytesIO(text))]
    assert max(sizes) < (1 << 16) + 200 and len(sizes) == -(-len(text) // (1 << 16))
    assert sum(len(json.loads(t)["log_history"]) for _, t in found.texts(io.BytesIO(text))) == 200_000
    torn = states.log_slices(io.BytesIO(text[:-100]), 1 << 16)
    assert torn.spans == [] and len(torn.head + torn.tail) < (1 << 16) + 200


def test_runs_are_evaluated_from_states_in_slices(spark, runs_dir, tmp_path, monkeypatch):
    log = [{"loss": float(i), "step": i} for i in range(500)] + [{"eval_loss": 0.5}, {"train_runtime": 72.0}]
    (Path(runs_dir) / "sft_a" / "trainer_state.json").write_text(json.dumps({"log_history": log, "global_step": 502}))
    monkeypatch.setattr(readers, "SLICE_BYTES", 1_000)
    held, rows = [], metrics.log_rows
    monkeypatch.setattr(metrics, "log_rows", lambda states: held.append(states) or rows(states))
    got = {r.run: r for r in evaluate.evaluate_runs(spark, runs_dir, str(tmp_path / "out"), ["id"], None).collect()}
    sft = got["sft_a"]
    assert (sft.initial_train_loss, sft.final_train_loss, sft.best_eval_loss, sft.total_steps, sft.training_time_hours) == (
        0.0, 499.0, 0.5, 502, 0.02)
    assert got["DPO_b"].total_steps == 1000
    cells = held[0].select("run", "first", F.size("log_history").alias("n")).collect()
    assert {r.run for r in cells} == {"sft_a", "DPO_b"} and len(held) == 1
    assert max(r.n for r in cells) < 50 and sum(r.n for r in cells if r.run == "sft_a") == 502


def test_seen_words_are_scored_without_a_table_of_each_task_s_words(spark):
    words = spark.createDataFrame([("en", "the", 3), ("en", "cat", 1)], "run string, token string, c bigint")
    model = ngram.NgramModel(1, words, spark.createDataFrame([("en", 4, 2)], "run string, n bigint, v bigint"))
    test = spark.createDataFrame([(1, "en", "the the cat zzz"), (1, "en", "the"), (None, "en", "cat"), (2, None, "cat")],
                                 "id int, run string, text string")
    tokenised = test.select("id", "run", F.split("text", " ").alias("tokens"))
    hits = ngram._hits(tokenised, model, ["id"], ["id", "run"], 0.5)
    assert "count(1)" not in hits._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.id, r.run): (r.loss, r.num_tokens) for r in ngram.sequence_loss(test, model, ["id"], own_run="run").collect()}
    log = math.log
    assert got == {(1, "en"): (pytest.approx(log(7) - (3 * log(4) + log(2)) / 5), 5), (None, "en"): (pytest.approx(log(7) - log(2)), 1)}


def test_shares_are_worked_out_for_used_pairs_only(spark, monkeypatch, tmp_path):
    train, test = frames_of(spark)
    ngram.fit_ngram(train, order=2).save(str(tmp_path / "m"))
    model, looked_up, plain = ngram.NgramModel.load(spark, str(tmp_path / "m"), 2), [], ngram.pair_shares
    monkeypatch.setattr(ngram, "pair_shares", lambda pairs, model: looked_up.append(pairs) or plain(pairs, model))
    got = {(r.id, r.run): r.loss for r in ngram.sequence_loss(test, model, ["id"]).collect()}
    assert got == {k: pytest.approx(v[0]) for k, v in brute_force(2).items()}
    found = {(r.run, r.ctx, r.token) for pairs in looked_up for r in pairs.collect()}
    assert found == {("en", "the", "cat"), ("en", "cat", "sat")} and model.pairs.count() > len(found)


def _mixed_pairs(spark):
    rows = [(1, "a b", "c c"), (1, "a", "x"), (2, "b a", "b a"), (2, None, "a"), (3, "", "a"), (4, "q", None),
            (None, "c", "a b zz"), (5, "a " * 40, "b")]
    model = ngram.fit_ngram(spark.createDataFrame([("r", "a b b c"), ("s", "c c d"), ("t", "e")], "run string, text string"))
    return spark.createDataFrame(rows, "id int, chosen string, rejected string"), ngram.MixedModel(ngram.pool(model), model, 0.3)


def test_few_runs_of_a_mix_are_scored_in_one_grouping(spark, monkeypatch):
    pairs, model = _mixed_pairs(spark)
    found = ngram.preference_losses(pairs, model, ["id"])
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted((str(r.id), r.run, round(r.chosen_loss, 9), round(r.rejected_loss, 9)) for r in df.collect())
    got = rows(found)
    assert len(got) == 12 and rows(ngram.preference_losses(pairs, model, ["id"], ["s"])) == [r for r in got if r[1] == "s"]
    capped = rows(ngram.preference_losses(pairs, model, ["id"], max_tokens=1))
    monkeypatch.setattr(ngram, "FEW_RUNS", 0)
    assert rows(ngram.preference_losses(pairs, model, ["id"])) == got
    assert rows(ngram.preference_losses(pairs, model, ["id"], max_tokens=1)) == capped
    ties = [r for r in got if r[0] == "2" and r[1] == "r"]
    assert len(ties) == 1


def test_evaluation_makes_its_pairs_once(spark):
    pairs, mixed = _mixed_pairs(spark)
    made = spark.sparkContext.accumulator(0)

    def seen(row):
        made.add(1)
        return {}

    runs = mixed.adapter.runs().withColumn("load_as", F.when(F.col("run") == "r", "lora").otherwise("full"))
    counted = scoring.map_rows(pairs, seen, pairs.schema)
    table = evaluate.evaluate(runs, ["id"], mixed.adapter, prefs=counted, base=mixed.base)
    assert {r.run: r.preference_total for r in table.collect()} == {"r": 4, "s": 5, "t": 5}
    assert made.value == pairs.count()
