import random

import pytest
from pyspark.sql import functions as F

from prefloom.operators import contracts, project, sample
from prefloom.operators import skew
from prefloom.operators.skew import salted_join
from prefloom.plans import evaluate, prepare, registry

CHAT = "array<struct<role string, content string>>"


def chat_pairs(spark, n=6):
    rows = [(i, f"p{i}", [("user", f"p{i}"), ("assistant", f"a{i}")], [("user", f"p{i}"), ("assistant", f"b{i}")], float(i), 1.0)
            for i in range(n)]
    return spark.createDataFrame(rows, f"id int, prompt string, chosen {CHAT}, rejected {CHAT}, score_chosen double, score_rejected double")


@pytest.mark.parametrize("method,schema,ok", [
    ("SFT", f"messages {CHAT}", True), ("sft", "text string", True), ("sft", "prompt string", True),
    ("sft", f"chosen {CHAT}", False), ("sft", "messages string", False),
    ("dpo", "chosen string, rejected string", True), ("orpo", "chosen string", False),
    ("dpo", "chosen int, rejected int", False),
    ("kto", "chosen array<string>, rejected array<string>", True),
    ("kto", "prompt string, completion string, label int", True),
    ("kto", "prompt string, completion string, label string", False),
    ("grpo", "prompt string", True), ("grpo", "chosen string", False),
    ("grpo", f"prompt string, chosen {CHAT}, rejected {CHAT}, score_chosen string", False),
    ("ppo", "prompt string", False),
])
def test_contracts(spark, method, schema, ok):
    df = spark.createDataFrame([], schema)
    if ok:
        contracts.check(method, df)
    else:
        with pytest.raises(contracts.ContractError):
            contracts.check(method, df)


def test_kto_contract_without_deriving(spark):
    with pytest.raises(contracts.ContractError):
        contracts.check("kto", chat_pairs(spark), derive_kto=False)


def test_sft_projection_takes_chosen(spark):
    df = chat_pairs(spark).withColumn("messages", F.col("rejected"))
    out = prepare.prepare("sft", df, ["id"])
    assert set(out.columns) == {"id", "messages", "score_chosen", "score_rejected"}
    assert out.orderBy("id").first().messages[1].content == "a0"


def test_unpair_doubles_and_balances(spark):
    out = project.kto_rows(chat_pairs(spark), keep=["id"])
    assert out.count() == 12 and out.where("label").count() == 6
    assert str(out.schema["label"].dataType) == "BooleanType()"
    words = spark.createDataFrame([(["q", "good"], ["q", "bad"])], "chosen array<string>, rejected array<string>")
    assert sorted((r.prompt, r.completion, r.label) for r in project.kto_rows(words).collect()) == [
        ("q", "bad", False), ("q", "good", True)]


def test_unpair_scans_once(spark, tmp_path):
    chat_pairs(spark).write.parquet(str(tmp_path / "p"))
    plan = project.kto_rows(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_implicit_prompt(spark):
    rows = [
        (1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")]),
        (2, [("user", "x")], [("user", "y")]),
        (3, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "a")]),
        (4, [("user", "q")], [("user", "q"), ("assistant", "b")]),
    ]
    df = spark.createDataFrame(rows, f"id int, chosen {CHAT}, rejected {CHAT}")
    got = {r.id: tuple([m.content for m in part] for part in (r.prompt, r.chosen, r.rejected))
           for r in project.with_prompt(df).collect()}
    assert got == {1: (["q"], ["a"], ["b"]), 2: ([], ["x"], ["y"]), 3: (["q", "a"], [], []), 4: (["q"], [], ["b"])}
    given = project.with_prompt(df.withColumn("prompt", F.when(F.col("id") == 1, "mine"))).where("id = 1").first()
    assert given.prompt[0].content == "mine" and len(given.chosen) == 2


def test_grpo_rows(spark):
    row = project.grpo_rows(chat_pairs(spark), ["id"]).orderBy("id").collect()[2]
    assert (row.prompt, row.chosen, row.rejected, row.score_chosen) == ("p2", "a2", "b2", 2.0)
    bare = project.grpo_rows(spark.createDataFrame([("p",)], "prompt string")).first()
    assert (bare.chosen, bare.rejected, bare.score_chosen, bare.score_rejected) == (None, None, 0.0, 0.0)


def test_shuffle_does_not_depend_on_partitions(spark):
    df = spark.range(200)
    orders = [[r.id for r in sample.seeded_shuffle(df.repartition(n), ["id"]).collect()] for n in (1, 4, 16)]
    assert orders[0] == orders[1] == orders[2] != sorted(orders[0])
    assert sorted(orders[0]) == list(range(200))


@pytest.mark.parametrize("seed", [None, 42])
@pytest.mark.parametrize("n", [0, 1, 7, 60, 99, 100, 500])
def test_large_samples_equal_small_ones(spark, seed, n):
    rng = random.Random(3)
    rows = [(rng.choice([5, 5, 5, 10 ** 12, rng.randrange(10 ** 6)]), i) for i in range(100)]
    df = spark.createDataFrame(rows, "k bigint, i bigint").repartition(5)
    small = sample.take_first(df, n, ["k", "i"], seed)
    large = sample.take_first(df, n, ["k", "i"], seed, top_rows=3)
    assert sorted(small.collect()) == sorted(large.collect())
    assert large.count() == (min(n, 100) or 100)


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_samples_take_any_key_and_nulls_at_every_size(spark, kind):
    values = [None] * 5 + ([f"k{i:02d}" for i in range(25)] if kind == "string" else [-2**63, 2**63 - 1, *range(23)])
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"k {kind}, i bigint").repartition(4)
    for n in (3, 5, 6, 27, 30, 40):
        small = sample.take_first(df, n, ["k", "i"]).collect()
        large = sample.take_first(df, n, ["k", "i"], top_rows=1).collect()
        assert len(small) == min(n, 30) and set(small) == set(large)
        assert sum(r.k is None for r in small) == min(n, 5)


def test_kto_sample_counts_unpaired_rows(spark):
    rows = prepare.prepare("kto", chat_pairs(spark), ["id"], limit=5)
    whole = prepare.prepare("kto", chat_pairs(spark), ["id"])
    assert rows.collect() == whole.limit(5).collect()


def test_caps_differ(spark):
    rows = [(i, None if i % 2 else [("user", "q")], [("user", "q")]) for i in range(10)]
    df = spark.createDataFrame(rows, f"id int, chosen {CHAT}, rejected {CHAT}")
    keep = evaluate.both_sides(df)
    assert [r.id for r in sample.cap_by_position(df, 4, ["id"], keep).orderBy("id").collect()] == [0, 2]
    assert [r.id for r in sample.cap_by_valid(df, 4, ["id"], keep).orderBy("id").collect()] == [0, 2, 4, 6]


def test_splits_prune_and_limit(spark, tmp_path):
    df = chat_pairs(spark).withColumn("split", F.when(F.col("id") < 4, "train").otherwise("test"))
    df.write.partitionBy("split").parquet(str(tmp_path / "s"))
    train, held_out = prepare.prepare_splits("dpo", spark.read.parquet(str(tmp_path / "s")), ["id"], "train", "test", 3, 1)
    assert (train.count(), held_out.count()) == (3, 1)
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().executedPlan().toString()


def test_registry_can_be_extended(spark):
    registry.add_method("longest", registry.Method(
        lambda df: None, lambda df, keep: df.select(*keep, F.length("prompt").alias("n"))))
    assert prepare.prepare("LONGEST", chat_pairs(spark), ["id"], 2).columns == ["id", "n"]
    registry.METHODS.pop("longest")
    with pytest.raises(contracts.ContractError):
        prepare.prepare("longest", chat_pairs(spark), ["id"])


def test_places_in_the_seeded_order(spark):
    df = spark.range(300).withColumn("_slice", F.lit(1))
    want = {r.id: i for i, r in enumerate(sample.seeded_shuffle(df, ["id"]).collect())}
    for n in (1, 4, 16):
        got = sample.seeded_order(df.repartition(n), ["id"])
        assert got.columns == ["id", "_slice", "position"] and {r.id: r.position for r in got.collect()} == want
    assert sample.seeded_order(df.where("false"), ["id"]).count() == 0
    with pytest.raises(ValueError, match="position"):
        sample.seeded_order(df.withColumn("position", F.lit(1)), ["id"])


def test_selection_sorts_nothing_whole(spark):
    df = spark.range(5000).select("id", F.lit("x" * 10).alias("wide"))
    cut = sample.take_first(df, 3000, ["id"], top_rows=10)
    assert sorted(r.id for r in cut.collect()) == list(range(3000))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "TakeOrderedAndProject" in plan


def test_rows_by_path_split_or_table(spark, tmp_path):
    df = chat_pairs(spark).withColumn("split", F.when(F.col("id") < 4, "train").otherwise("test"))
    nested, file = str(tmp_path / "deep" / "data"), tmp_path / "one.jsonl"
    df.withColumn("day", F.col("id") % 2).write.partitionBy("day", "split").parquet(nested)
    (tmp_path / "deep" / "data" / "notes.txt").write_text("not data")
    train, held_out = prepare.prepare_path(spark, "dpo", nested, ["id"], "train", "test", 3, 1)
    assert (train.count(), held_out.count()) == (3, 1)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    file.write_text('{"id": 1, "prompt": "p", "text": "t"}\n{"id": 2, "prompt": "q", "text": "u"}\n')
    rows, none = prepare.prepare_path(spark, "sft", str(file), ["id"], max_train=1)
    assert rows.count() == 1 and none is None
    df.createOrReplaceTempView("pairs_by_split")
    assert prepare.prepare_path(spark, "dpo", "pairs_by_split", ["id"], "test")[0].count() == df.where("split = 'test'").count()
    with pytest.raises(ValueError, match="split"):
        prepare.prepare_path(spark, "sft", str(file), ["id"], eval_split="test")
    with pytest.raises(FileNotFoundError):
        prepare.prepare_path(spark, "sft", str(tmp_path / "none"), ["id"])
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        prepare.prepare_path(spark, "sft", str(tmp_path / "empty"), ["id"])


def test_hot_keys_need_no_share_of_all_rows(spark):
    rows = spark.range(200_000).select(
        F.when(F.col("id") < 100, "warm").when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    hot = {r._key: r._salts for r in skew.hot_keys(rows, ["k"], hot_rows=20).collect()}
    of = {r.k: r.h for r in spark.createDataFrame([("warm",), ("hot",)], "k string").select("k", F.xxhash64("k").alias("h")).collect()}
    assert hot == {of["warm"]: 5, of["hot"]: (100_000 - 50) // 20 + 1}
    assert skew.hot_keys(rows.where("false"), ["k"], 1).count() == 0
    dealt = salted_join(rows.withColumn("id", F.monotonically_increasing_id()), spark.createDataFrame([("hot", 1)], "k string, v int"),
                        ["k"], ["id"], "inner", hot_rows=10_000)
    assert dealt.count() == 99_950


def test_hot_keys_merge_over_tasks_without_a_lane(spark):
    """More shuffle partitions than lanes, none of them coalesced: most merging tasks have no sketch."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ("20", "false")):
            spark.conf.set(name, value)
        rows = spark.range(1000).select((F.col("id") % 2 * F.col("id")).alias("k"))
        assert [r._salts for r in skew.hot_keys(rows, ["k"], hot_rows=100).collect()] == [5]
        nulls = rows.select(F.lit(None).cast("string").alias("k"))
        assert salted_join(nulls.withColumn("i", F.lit(1)), nulls.limit(0), ["k"], ["i"]).count() == 1000
        assert skew.hot_keys(rows.where("false"), ["k"], 1).count() == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
                                   .otherwise(F.concat(F.lit("k"), (F.col("id") % 11).cast("string"))).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k5", 4), (None, 5)], "k string, v int")
    plain = left.join(right, ["k"], how).select("id", "k", "v")
    salted = salted_join(left, right, ["k"], ["id"], how, hot_rows=30).select("id", "k", "v")
    assert plain.exceptAll(salted).count() == salted.exceptAll(plain).count() == 0
    by_weight = salted_join(left, right.withColumn("w", F.lit(50)), ["k"], ["id"], how, hot_rows=60,
                            hot_from=right.withColumn("w", F.lit(50)), weight="w").select("id", "k", "v")
    assert plain.exceptAll(by_weight).count() == by_weight.exceptAll(plain).count() == 0
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], ["id"], "full")
