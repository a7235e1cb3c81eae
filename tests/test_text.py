import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.functions import text as X
from prefloom.schemas import MESSAGES
from prefloom.sources.readers import parse_messages

CHAT_TYPE = "id int, m array<struct<role string, content string>>"


def one(spark, column, value, schema):
    return spark.createDataFrame([(value,)], f"v {schema}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw,want", [
    ("  a b \n", "a b"), ("　x　", "x"), ("", ""), ("\x1c y\x85", "y"), (" \n\t", ""), ("a\nb", "a\nb"), (None, None),
])
def test_strip_matches_python(spark, raw, want):
    assert one(spark, X.strip, raw, "string") == want
    if raw is not None:
        assert want == raw.strip()


def chats(spark):
    return spark.createDataFrame([
        (1, [("user", "hi"), ("assistant", "yo")]),
        (2, [("system", "be kind"), ("user", "a"), ("assistant", "b"), ("user", "c")]),
        (3, None), (4, []), (5, [(None, "x"), ("assistant", None)]),
    ], CHAT_TYPE)


def test_message_layouts(spark):
    m = F.col("m")
    rows = {r.id: r for r in chats(spark).select(
        "id", X.format_messages(m).alias("loose"), X.format_messages_strict(m).alias("strict"),
        X.chat_prompt(m).alias("prompt"), X.last_assistant(m).alias("last")).collect()}
    assert rows[1].loose == rows[1].strict == "user: hi\nassistant: yo"
    assert (rows[3].loose, rows[4].loose) == ("", "")
    assert rows[5].loose == ": x\nassistant: " and rows[5].strict is None
    assert rows[1].prompt == "User: hi\nAssistant:"
    assert rows[2].prompt == "be kind\nUser: c\nAssistant:"
    assert (rows[1].last, rows[2].last, rows[5].last) == ("yo", "b", "")
    assert rows[4].last == "[]"


@pytest.mark.parametrize("generated,prompt,want", [
    ("User: q\nAssistant: first\nAssistant:  second \n", "q", "second"),
    ("the prompt and more ", "the prompt", "and more"),
    ("User: q\nAssistant:", "q", ""),
])
def test_reply_of(spark, generated, prompt, want):
    df = spark.createDataFrame([(generated, prompt)], "g string, p string")
    assert df.select(X.reply_of(F.col("g"), F.col("p")).alias("r")).first().r == want


def test_to_text_shapes(spark):
    messages = [("user", "q"), ("assistant", None)]
    df = spark.createDataFrame([(messages, ["a", "b"], "s", 3), (None, None, None, None)],
                               "m array<struct<role string, content string>>, l array<string>, s string, n int")
    show = lambda c, **k: X.to_text(F.col(c), df.schema[c].dataType, **k).alias(c + "_".join(k.values()))
    full, empty = df.select(show("m"), show("m", render="json"), show("l"), show("s"), show("n")).collect()
    assert (full.m, full.l, full.s, full.n) == ("q\n", "a\nb", "s", "3")
    assert full.mjson == '{"role":"user","content":"q"}\n{"role":"assistant"}'
    assert list(empty) == ["", "", "", "", ""]
    with pytest.raises(ValueError):
        X.to_text(F.col("m"), MESSAGES, "repr")


def test_completion_text(spark):
    df = spark.createDataFrame([([("assistant", "x"), ("user", "y")], "z")], "m array<struct<role string, content string>>, s string")
    row = df.select(X.completion_text(F.col("m"), df.schema["m"].dataType).alias("m"),
                    X.completion_text(F.col("s"), T.StringType()).alias("s")).first()
    assert (row.m, row.s) == ("x", "z")


@pytest.mark.parametrize("text", ["", "aab", "a\nb\n", "😀😀é", "  "])
def test_distinct_chars(spark, text):
    assert one(spark, X.distinct_chars, text, "string") == len(set(text))


def test_tokens(spark):
    assert one(spark, X.tokens, " a  b\nc ", "string") == ["a", "b", "c"]
    assert one(spark, lambda c: X.tokens(c, 2), " a  b\nc ", "string") == ["a", "b"]
    assert one(spark, X.tokens, "", "string") == []


@pytest.mark.parametrize("path,step", [
    ("runs/a/checkpoint-500", 500), ("runs\\a\\checkpoint-1000\\x", 1000), ("checkpoint-x", -1), ("", -1)])
def test_checkpoint_step(spark, path, step):
    assert one(spark, X.checkpoint_step, path, "string") == step


def test_names_and_numbers(spark):
    assert one(spark, X.base_name, "runs\\quick_dpo", "string") == "quick_dpo"
    assert one(spark, X.base_name, "a/b/c/", "string") == "c"
    assert one(spark, X.method_list, " sft, ,DPO,", "string") == ["sft", "DPO"]
    assert one(spark, lambda c: X.number_or_na(c, "%.4f"), 0.0, "double") == "N/A"
    assert one(spark, lambda c: X.number_or_na(c, "%.2f"), None, "double") == "N/A"
    assert one(spark, lambda c: X.number_or_na(c * 100, "%.2f%%"), 0.655, "double") == "65.50%"


def test_message_literal(spark):
    assert one(spark, parse_messages, '[{"role":"user","content":"q"}]', "string")[0].content == "q"
    assert one(spark, parse_messages, "not json", "string") is None
