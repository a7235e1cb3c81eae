"""JSON expressions on variant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.text import strip

_WRAP_KEYS = ("v", "__end__")


def parse_strict(text: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else null.

    ``try_parse_json`` alone stops at the end of the first value, so the text is
    wrapped in an object with a closing sentinel key: trailing text breaks the wrap.
    """
    wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"__end__":0}'))
    keys = F.array(*[F.lit(k) for k in _WRAP_KEYS])
    whole = F.json_object_keys(wrapped) == keys
    return F.when(whole, F.variant_get(F.try_parse_json(wrapped), "$.v", "variant"))


def is_array(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))


def is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def has_key(v: Column, key: str) -> Column:
    """True when an object holds the key, even with a JSON null in it."""
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def field(v: Column, key: str, dtype: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{key}", dtype)


def text_lines(text: Column) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda x: x != "")
