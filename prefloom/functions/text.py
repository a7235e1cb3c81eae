"""Text expressions over strings and message lists (``array<struct<role, content>>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values shared with the result files and prompts other tools read.
ADAPTER_FILE = "adapter_model.safetensors"
FULL_MODEL_FILES = ("pytorch_model.bin", "model.safetensors")
ADAPTER_CONFIG_FILE = "adapter_config.json"
TRAINER_STATE_FILE = "trainer_state.json"
REPLY_MARKER = "Assistant:"
MAX_TOKENS = 512

_EDGE_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(c: Column) -> Column:
    """Drop all Unicode white space at both ends (Spark's ``trim`` drops spaces only)."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def not_blank(c: Column) -> Column:
    """True for text with something other than white space in it."""
    return strip(F.coalesce(c, F.lit(""))) != ""


def not_empty(c: Column, dtype: T.DataType) -> Column:
    """False for null, ``''`` and ``[]``."""
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) > 0
    return F.coalesce(c, F.lit("")) != ""


# ----------------------------------------------------------------- messages

def _turn(m: Column) -> Column:
    return F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))


def format_messages(messages: Column) -> Column:
    """``role: content`` per message, one per line; absent parts become ``''``."""
    return F.coalesce(F.array_join(F.transform(messages, _turn), "\n"), F.lit(""))


def format_messages_strict(messages: Column) -> Column:
    """As :func:`format_messages`, but null when a message lacks its role or content."""
    broken = F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull())
    return F.when(~broken, F.array_join(F.transform(messages, _turn), "\n"))


def as_user_message(text: Column) -> Column:
    """Wrap a text as a conversation of one user message."""
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))


def as_messages(c: Column, dtype: T.DataType) -> Column:
    """Widen text, a [prompt, reply] list or a message list to a message list."""
    if isinstance(dtype, T.StringType):
        return F.when(c.isNotNull(), F.array(
            F.struct(F.lit("assistant").alias("role"), c.alias("content"))))
    if isinstance(dtype.elementType, T.StringType):
        return F.transform(c, lambda x, i: F.struct(
            F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
            x.alias("content")))
    return F.transform(c, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def chat_prompt(messages: Column) -> Column:
    """System contents, then the last user turn, as a plain completion prompt."""
    systems = F.array_join(F.transform(
        F.filter(messages, lambda m: m["role"] == "system"),
        lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    last_user = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))
    return strip(F.concat(
        F.coalesce(systems, F.lit("")), F.lit("\nUser: "),
        F.coalesce(last_user["content"], F.lit("")), F.lit(f"\n{REPLY_MARKER} ")))


def generation_prompt(prompt: Column) -> Column:
    return F.concat(F.lit("User: "), prompt, F.lit(f"\n{REPLY_MARKER}"))


def last_assistant(messages: Column) -> Column:
    """Content of the last assistant turn; without one, the whole list as JSON."""
    turn = F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))
    return F.when(turn.isNotNull(), F.coalesce(turn["content"], F.lit(""))).otherwise(F.to_json(messages))


def reply_of(generated: Column, prompt: Column) -> Column:
    """Text after the last reply marker, else the text past the prompt; stripped."""
    after = F.substring_index(generated, REPLY_MARKER, -1)
    past = F.substring(generated, F.length(prompt) + 1, F.length(generated))
    return strip(F.when(F.contains(generated, F.lit(REPLY_MARKER)), after).otherwise(past))


# --------------------------------------------------------------- text views

def preference_view(prompt: Column, chosen: Column, rejected: Column) -> Column:
    return F.concat(F.lit("Prompt: "), prompt, F.lit("\nChosen: "), chosen, F.lit("\nRejected: "), rejected)


def labelled_view(prompt: Column, completion: Column, label: Column) -> Column:
    return F.concat(F.lit("Prompt: "), prompt, F.lit("\nCompletion: "), completion, F.lit("\nLabel: "), label)


def to_text(c: Column, dtype: T.DataType, render: str = "content") -> Column:
    """Null to ``''``, a list to its items one per line, anything else to a string.

    Message items show their content, or with ``render='json'`` the whole message.
    """
    if render not in ("content", "json"):
        raise ValueError(f"render must be 'content' or 'json', not {render!r}")
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.StructType):
            if render == "json":
                c = F.transform(c, lambda m: F.to_json(m))
            else:
                c = F.transform(c, lambda m: F.coalesce(m["content"], F.lit("")))
        else:
            c = F.transform(c, lambda x: x.cast("string"))
        return F.coalesce(F.array_join(c, "\n"), F.lit(""))
    if isinstance(dtype, T.StructType):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def completion_text(c: Column, dtype: T.DataType) -> Column:
    """First message's content of a message list, else the value as a string."""
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return F.coalesce(F.get(c, 0)["content"], F.lit(""))
    return to_text(c, dtype)


# ------------------------------------------------------------ tokens, chars

def tokens(text: Column, limit: int | None = None) -> Column:
    """Words between white space; the first ``limit`` of them when a limit is given."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    return words if limit is None else F.slice(words, 1, limit)


def distinct_chars(text: Column) -> Column:
    """Number of different characters (code points)."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))))


# -------------------------------------------------------------- run, numbers

def checkpoint_step(path: Column) -> Column:
    """Step in the first ``checkpoint-N`` of a path, -1 when there is none."""
    step = F.regexp_extract(path, r"checkpoint-(\d+)", 1)
    return F.coalesce(step.try_cast("bigint"), F.lit(-1).cast("bigint"))


def base_name(path: Column) -> Column:
    """Last part of a path with either kind of slash."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*\z", 1)


def adapter_label(run: Column, checkpoint: Column) -> Column:
    """``run`` for an adapter at the run's root, else ``run/checkpoint-N``."""
    return F.concat_ws("/", run, checkpoint)


def method_list(text: Column) -> Column:
    """Comma-separated names, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda m: m != "")


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def hours(seconds: Column) -> Column:
    return seconds / F.lit(3600.0)


def number_or_na(value: Column, pattern: str) -> Column:
    """Formatted number; null and 0 both show as ``N/A``."""
    return F.when(value != 0, F.format_string(pattern, value)).otherwise("N/A")
