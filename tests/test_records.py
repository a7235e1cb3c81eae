import json

import pytest
from pyspark.sql import functions as F

from prefloom.functions.json import parse_strict
from prefloom.operators import records
from prefloom.plans.ingest import ingest, ingest_path
from prefloom.sources import readers, sinks
from prefloom.streaming.ingest import stream_records, write_stream
from suite import frames


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


@pytest.mark.parametrize("text,ok", [
    ('{"a":1}', True), ("[1,2]", True), ("7", True), ('"s"', True), ("null", True), ('{\n"a":\n1}', True),
    ('{"a":1} x', False), ('{"a":1}\n{"b":2}', False), ("1,2", False), ("1] x", False), ('{"a":1} ] [{"b":2}', False),
    ("", False), ("NaN", False), ('{"a":[1}', False), ("bad{", False),
])
def test_parse_strict_takes_one_whole_value(spark, text, ok):
    got = texts(spark, text).select(parse_strict(F.col("text")).isNotNull().alias("r")).first().r
    assert got is ok


def classified(spark, *values):
    df = records.classify(records.json_items(texts(spark, *values)))
    return [(r.id, r.item_pos, r.type, r.reject_reason) for r in
            df.select("id", "item_pos", "type", "reject_reason").orderBy("id", "item_pos").collect()]


def test_classifier_order_and_reasons(spark):
    got = classified(
        spark, '{"messages":null}', '{"chosen":"a","rejected":"b","messages":[]}', '{"completion":"c","label":0,"chosen":"x"}',
        '{"other":1}', "[1]", "3", "bad{", "[]", "", '[{"chosen":"a","rejected":"b"}, 5]')
    assert got == [
        (0, 0, "sft", None), (1, 0, "sft", None), (2, 0, "kto", None), (3, 0, None, "unrecognised"),
        (4, 0, None, "non_object"), (5, 0, None, "non_object"), (6, 0, None, "bad_json"),
        (7, None, None, "empty"), (8, None, None, "empty"), (9, 0, "dpo", None), (9, 1, None, "non_object")]


def test_line_fallback_skips_bad_and_blank_lines(spark):
    got = classified(spark, '{"messages":[]}\r\n\r\nbad\r\n  {"chosen":1,"rejected":2}  \n')
    assert [g[2:] for g in got] == [("sft", None), (None, "bad_json"), ("dpo", None)]


def test_canonical_values_and_views(spark):
    rows = {r.id: r for r in ingest(texts(
        spark,
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        '{"chosen":"c","rejected":"r","score_chosen":4,"score_rejected":1.5}',
        '{"prompt":null,"completion":"x","label":true}',
        '{"prompt":"p","completion":"y","label":0}',
        '{"chosen":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"rejected":["q","b"]}',
        '{"completion":"x","label":1,"label":0}',
    ))[0].collect()}
    assert rows[0].text == "user: q\nassistant: a" and rows[0].messages[1].content == "a"
    assert rows[1].prompt == "" and rows[1].text == "Prompt: \nChosen: c\nRejected: r"
    assert (rows[1].score_chosen, rows[1].score_rejected) == (4.0, 1.5)
    assert rows[2].prompt is None and rows[2].text == "Prompt: None\nCompletion: x\nLabel: True"
    assert rows[2].label is True and rows[3].label is False
    assert rows[3].text == "Prompt: p\nCompletion: y\nLabel: 0"
    assert [m.role for m in rows[4].rejected_messages] == ["user", "assistant"]
    assert rows[4].chosen_messages[1].content == "a"
    assert rows[5].label is False


def test_reject_counts(spark):
    counts = {r.reject_reason: r.n for r in ingest(texts(spark, "bad{", "[1,2]", '{"x":1}', '{"messages":[]}'))[1].collect()}
    assert counts == {"bad_json": 1, "non_object": 2, "unrecognised": 1}


def test_strict_list(spark):
    items = readers.strict_list(texts(spark, '[{"a":1},2]'))
    assert [r.item_pos for r in items.select("item_pos").orderBy("item_pos").collect()] == [0, 1]
    for bad in ('{"a":1}', "[1] x", "bad"):
        with pytest.raises(Exception, match="must be a JSON list"):
            readers.strict_list(texts(spark, bad)).select("item_pos").collect()


def test_ingest_path_by_layout(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"messages": []}, {"chosen": "c", "rejected": "r"}], indent=1))
    (folder / "b.jsonl").write_text('{"completion":"c","label":1}\nbad\n' + '{"messages":[]}\n' * 20)
    out, rejects = ingest_path(spark, str(folder), str(tmp_path / "out"))
    count = lambda df: {r.type: r["count"] for r in df.groupBy("type").count().collect()}
    assert count(out) == {"sft": 21, "dpo": 1, "kto": 1}
    assert {r.reject_reason: r.n for r in rejects.collect()} == {"bad_json": 1}
    by_line, _ = ingest(readers.read_texts(spark, str(folder / "b.jsonl"), "lines"))
    assert count(by_line) == {"sft": 20, "kto": 1}
    with pytest.raises(ValueError, match="layout"):
        readers.read_texts(spark, str(folder), "rows")


def test_failed_ingest_leaves_what_was_there(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"messages":[]}')
    out = str(tmp_path / "out")
    assert ingest_path(spark, str(tmp_path / "x.json"), out)[0].count() == 1
    (tmp_path / "y.json").write_text("[7]")
    with pytest.raises(ValueError, match="no valid"):
        ingest_path(spark, str(tmp_path / "y.json"), out)
    assert sinks.read_published(spark, out).count() == 1
    assert ingest_path(spark, str(tmp_path / "x.json"), out)[0].count() == 1
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("v-")]) == 2
    with pytest.raises(ValueError, match="below"):
        ingest_path(spark, str(tmp_path), out)


def test_broken_off_publish_leaves_the_old_records(spark, tmp_path, monkeypatch):
    text, out = tmp_path / "x.json", str(tmp_path / "my out")
    for n in (1, 2, 3):
        text.write_text(json.dumps([{"messages": []}] * n))
        assert ingest_path(spark, str(text), out)[0].count() == n
    text.write_text(json.dumps([{"messages": []}] * 9))
    held = sinks.read_published(spark, out)

    def broken(*_):
        raise RuntimeError("lost")

    for step in ("commit", "_put"):
        with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
            m.setattr(sinks, step, broken)
            ingest_path(spark, str(text), out)
        assert sinks.read_published(spark, out).count() == 3
    assert ingest_path(spark, str(text), out)[0].count() == 9
    assert held.count() == 3  # a reader under way still has the version before
    spark.range(4).write.parquet(str(tmp_path / "plain"))
    assert sinks.read_published(spark, str(tmp_path / "plain")).count() == 4


def test_written_files_hold_what_the_rows_say(spark, tmp_path):
    rows = [("a b/c.txt", "x"), ("é/[1].json", "\n"), ("top", None)]
    for root in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        sinks.write_files(spark.createDataFrame(rows, "path string, content string"), root)
        base = tmp_path / root.rsplit("/", 1)[1]
        assert {str(p.relative_to(base)): p.read_text() for p in base.rglob("*") if p.is_file()} == {
            n: t or "" for n, t in rows}


def test_files_are_written_from_pieces(spark, tmp_path):
    n = 30_000
    pieces = spark.range(n).select(
        F.lit("a b/log").alias("path"), F.lit(1).alias("part"), F.col("id").alias("pos"), F.col("id").cast("string").alias("content"))
    around = spark.createDataFrame(
        [("a b/log", 0, 0, "["), ("a b/log", 2, 0, "]"), ("é/one", 0, 0, "x"), ("é/none", 0, 0, None), (None, 0, 0, "y"),
         ("twice", 0, 1, "old"), ("twice", 1, 1, "old"), ("twice", 0, 2, "new"), ("commas", 4, 0, "1"), ("commas", 4, 1, "2")],
        "path string, part int, pos bigint, content string")
    rows = pieces.unionByName(around).withColumn("again", F.when(F.col("path") == "twice", F.col("pos")))
    for root in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        sinks.write_pieces(rows, root, ["again", "part", "pos"])
        base = tmp_path / root.rsplit("/", 1)[1]
        assert {str(p.relative_to(base)): p.read_text() for p in base.rglob("*") if p.is_file()} == {
            "a b/log": "[" + ",".join(map(str, range(n))) + "]", "é/one": "x", "é/none": "", "twice": "new", "commas": "1,2"}


def test_a_run_folder_is_written_without_a_cell_per_state(spark, tmp_path):
    events = [(i, i % 7 if i % 10 else None, ("click", "purchase", "error", "other")[i % 4], i / 4 if i % 9 else None) for i in range(400)]
    events += events[:40]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    tree = frames.run_tree(spark, str(tmp_path), F.col("user_id") % 6)
    assert "collect_list" not in tree._jdf.queryExecution().optimizedPlan().toString()
    sinks.write_pieces(tree, str(tmp_path / "runs"), frames.PIECES, content=F.coalesce("text", F.to_json("entry")))
    got = {str(p.relative_to(tmp_path / "runs")): p.read_text() for p in (tmp_path / "runs").rglob("*") if p.is_file()}
    want = {}
    for g in range(6):
        name, files, at = frames.KINDS[g]
        run = f"{name}{g}"
        want |= {f"{run}/{f}": str(g) for f in files}
        own = sorted((e for e in events if e[1] is not None and e[1] % 6 == g), key=lambda e: e[0])
        for folder in ("", "checkpoint-800", "checkpoint-900", "checkpoint-1000"):
            logged = [e for e in own if not folder or folder == f"checkpoint-{(e[0] % 3 + 8) * 100}"]
            if not logged:
                continue
            if folder:
                want[f"{run}/{folder}/adapter_model.safetensors"] = folder
            if at != "root" if folder == "" else (folder == "checkpoint-1000" and at == "some checkpoints"):
                continue
            entry = lambda e: {k: v for k, v in (
                ("step", e[0]), ("loss", e[3] if e[2] == "click" else None), ("eval_loss", e[3] if e[2] == "purchase" else None),
                ("train_runtime", e[3] if e[2] == "error" else None)) if v is not None}
            state = {"global_step": len(logged)} | ({"best_model_checkpoint": folder} if folder else {})
            want[f"{run}/{folder}/trainer_state.json".replace("//", "/")] = json.dumps(
                state | {"log_history": [entry(e) for e in logged]}, separators=(",", ":"))
    assert got == want


def test_typed_paths(spark, tmp_path):
    frame = spark.createDataFrame([(1, "x")], "id int, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "pq"))
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "A.JSON").write_text('{"id":5}\n')
    (tmp_path / "mixed" / "b.parquet").write_bytes(b"not read")
    (tmp_path / "array.json").write_text('[\n{"id":1},\n{"id":2}]')
    (tmp_path / "t.csv").write_text("a")
    assert readers.read_path(spark, str(tmp_path / "pq")).first().text == "x"
    assert [r.id for r in readers.read_path(spark, str(tmp_path / "mixed"), "id int").collect()] == [5]
    assert readers.read_path(spark, str(tmp_path / "array.json"), "id int", array_files=True).count() == 2
    with pytest.raises(ValueError):
        readers.read_path(spark, str(tmp_path / "t.csv"))
    with pytest.raises(FileNotFoundError):
        readers.read_path(spark, str(tmp_path / "none"))
    (tmp_path / "bare").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_path(spark, str(tmp_path / "bare"))


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    lines = ['{"messages":[{"role":"user","content":"q"}]}', "bad", '{"chosen":"c","rejected":"r"}', '{"completion":"c","label":1}']
    for i in range(3):
        (folder / f"{i}.jsonl").write_text("\n".join(lines))
    stream = stream_records(spark, str(folder))
    query = write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("type", "text")
    batch = spark.read.text(str(folder)).withColumnRenamed("value", "text")
    want = ingest(batch)[0].select("type", "text")
    assert want.count() == 9
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_array_files_read_in_splits_give_the_items_of_the_whole_text(spark, tmp_path):
    items = [{"a": [i, {"b": "x,]\\\"}[" * (i % 7)}], "c": None} for i in range(300)] + ["s, [", 7, [], {}, [[1], [2, [3]]], True, None]
    texts = {"one.json": json.dumps(items, indent=2), "two.json": json.dumps(items), "none.json": " [ \n ] \n", "single.json": "[\n1\n]"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        scan = spark.read.text(str(tmp_path))
        assert scan.rdd.getNumPartitions() > 5
        got = {}
        for r in readers.array_items(spark, str(tmp_path)).collect():
            got.setdefault(r.path.rsplit("/", 1)[1], {})[r.item_pos] = json.loads(r.text)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "gap.json").write_text("[1\n2, 3,\n]")
    gap = readers.array_items(spark, str(tmp_path / "gap.json")).orderBy("item_pos").collect()
    assert [r.text.split() for r in gap] == [["1", "2"], ["3"], []]
    assert got == {n: dict(enumerate(json.loads(t))) for n, t in texts.items() if json.loads(t)}


@pytest.mark.parametrize("text", ["[1, 2", "[1]\n]", "{\"a\": 1}", "[1] 2", "[1]\n[2]", "1", "[1}"])
def test_files_that_are_no_array_fail(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="not one JSON array"):
        readers.array_items(spark, str(tmp_path)).collect()
