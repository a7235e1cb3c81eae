"""Bounded, documented samples for fitting, and the fold that is held out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5

# Classes of bytes that features count.
CLASSES = ["space", "newline", "upper", "lower", "digit", "mark", "exclaim", "symbol", "other"]
_GROUPS = {"space": " \t\r\x0b\x0c", "newline": "\n", "exclaim": "!", "symbol": "#*$%&|<>@^~_=+\\/{}[]"}
CLASS_OF = np.full(256, CLASSES.index("other"), np.uint8)
for _name, _low, _high in (("mark", 0x21, 0x7F), ("upper", 0x41, 0x5B), ("lower", 0x61, 0x7B), ("digit", 0x30, 0x3A)):
    CLASS_OF[_low:_high] = CLASSES.index(_name)
for _name, _letters in _GROUPS.items():
    CLASS_OF[[ord(c) for c in _letters]] = CLASSES.index(_name)


def held_out(doc_id: str) -> Column:
    """Rows whose label is never learned from: CRC-32 of the id as text divides by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sample_labels(labels: DataFrame, doc_id: str, label: str, rows: int) -> DataFrame:
    """``doc_id, label`` of at most ``rows`` learnable rows, the first by a hash of the id.

    The smaller label of a repeated id counts. The result is small enough to broadcast.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(
        F.col(doc_id).alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    few = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return few.groupBy("doc_id").agg(F.min("label").alias("label"))


def byte_counts(raw: bytes) -> np.ndarray:
    """How many bytes of each class."""
    return np.bincount(CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES))
