"""Per-method projections of a preference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.functions import text as X


def sft_rows(df: DataFrame) -> DataFrame:
    """With both chosen and messages, train on chosen: it takes the place of messages."""
    if {"chosen", "messages"} <= set(df.columns):
        df = df.drop("messages", "rejected", "prompt").withColumnRenamed("chosen", "messages")
    return df


def pair_rows(df: DataFrame) -> DataFrame:
    """Pairs for the two pairwise methods: everything but ``messages``."""
    return df.drop("messages")


def with_prompt(df: DataFrame) -> DataFrame:
    """Where there is no prompt, take the leading messages chosen and rejected share.

    Adds or fills ``prompt`` (message list) and cuts the shared part off both sides.
    """
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    first_difference = F.array_position(same, F.lit(False))
    shared = F.when(first_difference > 0, first_difference - 1).otherwise(
        F.least(F.size("chosen"), F.size("rejected"))).cast("int")
    cut = df.withColumn("_shared", shared)
    prompt = F.slice("chosen", 1, F.col("_shared"))
    rest = {side: F.slice(side, F.col("_shared") + 1, F.size(side)) for side in ("chosen", "rejected")}
    if "prompt" in df.columns:
        absent = F.col("prompt").isNull()
        given = X.as_messages(F.col("prompt"), df.schema["prompt"].dataType)
        if isinstance(df.schema["prompt"].dataType, T.StringType):
            given = X.as_user_message(F.col("prompt"))
        prompt = F.when(absent, prompt).otherwise(given)
        rest = {side: F.when(absent, part).otherwise(F.col(side)) for side, part in rest.items()}
    return cut.select(
        *[c for c in df.columns if c not in ("prompt", "chosen", "rejected")],
        prompt.alias("prompt"), rest["chosen"].alias("chosen"), rest["rejected"].alias("rejected"))


def unpair(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each pair as two rows in one pass: prompt ``[x[0]]``, completion ``[x[1]]`` and the label.

    Text pairs give their own prompt and the text as completion.
    """
    dtype = df.schema["chosen"].dataType
    keep = keep or []

    def side(name: str, label: bool) -> Column:
        c = F.col(name)
        if isinstance(dtype, T.ArrayType):
            prompt, completion = F.array(F.get(c, 0)), F.array(F.get(c, 1))
        else:
            prompt, completion = (F.col("prompt") if "prompt" in df.columns
                                  else F.lit(None).cast("string")), c
        return F.struct(prompt.alias("prompt"), completion.alias("completion"), F.lit(label).alias("label"))

    sides = F.array(side("chosen", True), side("rejected", False))
    return df.select(*keep, F.inline(sides))


def kto_rows(df: DataFrame, render: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Ready or paired rows as ``prompt string, completion string, label boolean``."""
    ready = df if {"prompt", "completion", "label"} <= set(df.columns) else unpair(df, keep)
    return ready.select(
        *(keep or []),
        X.to_text(F.col("prompt"), ready.schema["prompt"].dataType, render).alias("prompt"),
        X.to_text(F.col("completion"), ready.schema["completion"].dataType, render).alias("completion"),
        F.col("label").cast("boolean").alias("label"))


def grpo_rows(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Prompt, the two replies and their scores; an absent score is 0, an absent side null."""

    def reply(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("string")
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.ArrayType):
            item = F.get(F.col(name), 1)
            return item["content"] if isinstance(dtype.elementType, T.StructType) else item
        return F.col(name)

    def score(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    return df.select(
        *(keep or []), "prompt",
        *[reply(n).alias(n) for n in ("chosen", "rejected")],
        *[score(n).alias(n) for n in ("score_chosen", "score_rejected")])
