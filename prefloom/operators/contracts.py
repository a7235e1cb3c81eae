"""Column contracts of the five tuning methods, checked on the schema before any job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column sets each method accepts, any one of which is enough.
CONTRACTS: dict[str, list[set[str]]] = {
    "sft": [{"messages"}, {"text"}, {"prompt"}],
    "dpo": [{"chosen", "rejected"}],
    "orpo": [{"chosen", "rejected"}],
    "kto": [{"prompt", "completion", "label"}, {"chosen", "rejected"}],
    "grpo": [{"prompt"}],
}

TEXT, CHAT, WORDS = "text", "list of messages", "list of strings"


class ContractError(ValueError):
    """The frame does not hold what the method needs."""


def kind(dtype: T.DataType) -> str | None:
    """Which of the accepted content shapes a column type is."""
    if isinstance(dtype, T.StringType):
        return TEXT
    if isinstance(dtype, T.ArrayType):
        item = dtype.elementType
        if isinstance(item, T.StringType):
            return WORDS
        if isinstance(item, T.StructType) and {"role", "content"} <= set(item.names):
            return CHAT
    return None


# Content shapes accepted per column.
SHAPES: dict[str, tuple[str, ...]] = {
    "messages": (CHAT,),
    "text": (TEXT,),
    "prompt": (TEXT, CHAT, WORDS),
    "completion": (TEXT, CHAT, WORDS),
    "chosen": (TEXT, CHAT, WORDS),
    "rejected": (TEXT, CHAT, WORDS),
}


def method_name(method: str) -> str:
    name = method.lower()
    if name not in CONTRACTS:
        raise ContractError(f"unknown method: {method}")
    return name


def check(method: str, df: DataFrame, derive_kto: bool = True) -> set[str]:
    """Raise unless ``df`` meets the method's contract; returns the column set it met.

    ``derive_kto=False`` accepts ready KTO rows only, not pairs to be split.
    """
    name = method_name(method)
    options = CONTRACTS[name]
    if name == "kto" and not derive_kto:
        options = options[:1]
    have = set(df.columns)
    met = next((need for need in options if need <= have), None)
    if met is None:
        wanted = " or ".join("+".join(sorted(need)) for need in options)
        raise ContractError(f"{name} needs columns {wanted}; got {sorted(have)}")
    used = met | (set() if name == "sft" else {"chosen", "rejected"} & have)
    for column in sorted(used & set(SHAPES)):
        found = kind(df.schema[column].dataType)
        if found not in SHAPES[column]:
            raise ContractError(
                f"{name}: column {column} must be {' or '.join(SHAPES[column])}, "
                f"got {df.schema[column].dataType.simpleString()}")
    if "label" in met and not isinstance(
            df.schema["label"].dataType, (T.BooleanType, T.IntegralType)):
        raise ContractError("kto: column label must be boolean or an integer")
    for score in {"score_chosen", "score_rejected"} & have if name == "grpo" else ():
        if not isinstance(df.schema[score].dataType, T.NumericType):
            raise ContractError(f"grpo: column {score} must be a number")
    return met


def accepts(method: str, has_key) -> Column:
    """Row-level form for records whose keys differ: ``has_key`` maps a name to a condition."""
    met = F.lit(False)
    for need in CONTRACTS[method_name(method)]:
        every = F.lit(True)
        for name in sorted(need):
            every = every & has_key(name)
        met = met | every
    return met
