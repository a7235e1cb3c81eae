"""JSON texts to classified training records, with a reason for every reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions import json as J
from prefloom.functions import text as X
from prefloom.schemas import CANONICAL

_MESSAGES = "array<struct<role string, content string>>"

# Reasons a text or item is not turned into a record.
EMPTY, BAD_JSON, NOT_OBJECT, UNKNOWN_KEYS = "empty", "bad_json", "non_object", "unrecognised"


def json_items(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per item of each text: ``item_pos`` and ``item`` (variant, null for a bad line).

    A text is one JSON array, one other JSON value, or failing both JSON lines.
    A text without any item gives one row with a null position.
    """
    whole = df.withColumn("_whole", J.parse_strict(F.col(text)))
    parsed = F.col("_whole")
    items = F.when(
        parsed.isNotNull(),
        F.when(J.is_array(parsed), parsed.cast("array<variant>")).otherwise(F.array(parsed)),
    ).otherwise(F.transform(J.text_lines(F.col(text)), J.parse_strict))
    keep = [c for c in df.columns if c != text]
    return whole.select(*keep, F.posexplode_outer(items).alias("item_pos", "item"))


def record_type(item: Column) -> Column:
    """Class by the keys present, first match wins: messages, then a pair, then a label."""
    return (
        F.when(J.has_key(item, "messages"), "sft")
        .when(J.has_key(item, "chosen") & J.has_key(item, "rejected"), "dpo")
        .when(J.has_key(item, "completion") & J.has_key(item, "label"), "kto")
    )


def classify(items: DataFrame) -> DataFrame:
    """Adds ``type`` and ``reject_reason``; exactly one of the two is set on each row."""
    item = F.col("item")
    flagged = items.withColumn("_object", F.coalesce(J.is_object(item), F.lit(False)))
    flagged = flagged.withColumn("type", F.when(F.col("_object"), record_type(item)))
    reason = (
        F.when(F.col("item_pos").isNull(), EMPTY)
        .when(item.isNull(), BAD_JSON)
        .when(~F.col("_object"), NOT_OBJECT)
        .when(F.col("type").isNull(), UNKNOWN_KEYS)
    )
    return flagged.withColumn("reject_reason", reason).drop("_object")


def _value(item: Column, key: str) -> Column:
    """String of a key: ``''`` when the key is absent, null when it holds a JSON null."""
    return F.when(J.has_key(item, key), J.field(item, key)).otherwise("")


def _shown(value: Column) -> Column:
    """A JSON null is shown as None in the text views."""
    return F.coalesce(value, F.lit("None"))


def canonical(classified: DataFrame) -> DataFrame:
    """Accepted items as rows of the canonical schema, other columns kept in front."""
    item = F.col("item")
    keep = [c for c in classified.columns if c not in ("item", "type", "reject_reason")]
    is_sft, is_dpo, is_kto = (F.col("type") == t for t in ("sft", "dpo", "kto"))
    pair = is_dpo | is_kto
    raw_label = J.field(item, "label")
    label_text = F.when(raw_label.isin("true", "false"), F.initcap(raw_label)).otherwise(raw_label)
    wide = classified.where(F.col("reject_reason").isNull()).select(
        *keep,
        "type",
        F.when(is_sft, J.field(item, "messages", _MESSAGES)).alias("messages"),
        F.when(pair, _value(item, "prompt")).alias("prompt"),
        F.when(is_dpo, _value(item, "chosen")).alias("chosen"),
        F.when(is_dpo, _value(item, "rejected")).alias("rejected"),
        F.when(is_kto, _value(item, "completion")).alias("completion"),
        F.when(is_kto, J.field(item, "label", "boolean")).alias("label"),
        F.when(is_kto, label_text).alias("_label_text"),
        F.when(is_dpo, _chat_or_null(item, "chosen")).alias("chosen_messages"),
        F.when(is_dpo, _chat_or_null(item, "rejected")).alias("rejected_messages"),
        F.when(is_dpo, J.field(item, "score_chosen", "double")).alias("score_chosen"),
        F.when(is_dpo, J.field(item, "score_rejected", "double")).alias("score_rejected"),
    )
    prompt, completion = _shown(F.col("prompt")), _shown(F.col("completion"))
    view = (
        F.when(is_sft, X.format_messages(F.col("messages")))
        .when(is_dpo, X.preference_view(prompt, _shown(F.col("chosen")), _shown(F.col("rejected"))))
        .when(is_kto, X.labelled_view(prompt, completion, _shown(F.col("_label_text"))))
    )
    return wide.withColumn("text", view).select(*keep, *CANONICAL.names)


def _chat_or_null(item: Column, key: str) -> Column:
    """The key as messages when it is a list of messages, or a [prompt, reply] string list."""
    shape = F.schema_of_variant(J.field(item, key, "variant"))
    words = J.field(item, key, "array<string>")
    turns = F.transform(words, lambda x, i: F.struct(
        F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        x.alias("content")))
    return (F.when(F.startswith(shape, F.lit("ARRAY<OBJECT")), J.field(item, key, _MESSAGES))
            .when(shape == "ARRAY<STRING>", turns))


def reject_counts(classified: DataFrame) -> DataFrame:
    """How many items were rejected, by reason."""
    return (classified.where(F.col("reject_reason").isNotNull())
            .groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n")))
