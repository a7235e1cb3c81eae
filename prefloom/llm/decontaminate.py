"""Benchmark decontamination with an Aho-Corasick automaton over normalised items.

Normalised words are runs of ASCII letters (lower case), digits and non-ASCII characters. A
window is ``window`` consecutive words of an item, or the whole item if it has fewer (but some).
A text is scanned once by the automaton of all windows, and hits are mapped back to words
and to byte offsets of the original text.

The automaton goes to every task, so its size is bounded: a benchmark of more than ``block_bytes``
is dealt over several automata of about that size. Documents pass one after the other, each row carrying
the runs of words hit so far, so rows never have to be told apart and results are those of a
single automaton. Each further automaton costs one more pass over the stored texts; the driver holds one
block of items at a time.

Edge cases: null and empty texts have no words and no hits; items without words never match;
equal items all count; repeated rows are judged each on their own, whatever their ids, which may be
null; an empty benchmark leaves every document clean. Columns beyond the named ones are not read,
and :func:`clean` hands them on as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.batches import as_bytes, map_rows
from prefloom.llm.tables import stored

WINDOW = 10
BLOCK_BYTES = 16_000_000
# Bytes below 0x80 other than digits and letters part words; capitals turn to small letters.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32
               for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


class Scanner:
    """The automaton of a list of (item, text) pairs."""

    def __init__(self, items: list[tuple], window: int):
        patterns: dict[str, set[int]] = {}
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            words = words_of((text or "").encode())
            for i in range(max(len(words) - window, 0) + 1 if words else 0):
                key = (b" " + b" ".join(words[i:i + window]) + b" ").decode("latin-1")
                patterns.setdefault(key, set()).add(k)
        self.automaton = ahocorasick.Automaton() if patterns else None
        for key, owners in patterns.items():
            self.automaton.add_word(key, (len(key), key.count(" ") - 1, tuple(owners)))
        if patterns:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence, and the items that occur."""
        hit = np.zeros(len(words), bool)
        found: set[int] = set()
        if not self.automaton or not words:
            return hit, found
        line = b" " + b" ".join(words) + b" "
        spaces = None
        for end, (length, n, owners) in self.automaton.iter(line.decode("latin-1")):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            first = int(np.searchsorted(spaces, end - length + 1))
            hit[first:first + n] = True
            found.update(owners)
        return hit, found


def runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and next-to-last place of each stretch of hits."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def byte_ranges(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original text from the first to the last word of each run."""
    normal = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], normal, [False]]).astype(np.int8)))
    return [(int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in runs]


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes``, each read when it is asked for."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    slot = F.pmod(F.xxhash64(item, text), F.lit(n))
    for k in range(n):
        yield [(r[0], r[1]) for r in benchmark.where(slot == k).select(item, text).toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, words hit, items that occur (as sorted strings) and hit spans.

    ``spans`` are byte ranges of the original text. Columns: ``doc_id, n_words, n_hit, item_ids, spans``.
    """
    ranges = T.ArrayType(T.ArrayType(T.LongType()))
    result = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()),
              T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", ranges)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"),
                       F.lit(None).cast("array<string>").alias("item_ids"), F.lit(None).cast(ranges).alias("runs"))
    first = True
    for items in benchmark_blocks(benchmark, item, item_text, block_bytes):
        if not first:
            rows = stored(rows, "scanned")
        rows = _scanned(rows.select("doc_id", "raw", "item_ids", "runs"), items, window,
                        T.StructType([*result, T.StructField("raw", T.BinaryType()), T.StructField("runs", ranges)]))
        first = False
    return rows.select(*[f.name for f in result])


def _scanned(rows: DataFrame, items: list[tuple], window: int, schema: T.StructType) -> DataFrame:
    """``rows`` after one more automaton: its hits joined to those that the rows bring along."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def make():
        scanner = Scanner(shared.value, window)

        def run(batch):
            n_words, n_hit, names, spans, all_runs = [], [], [], [], []
            for raw, before, runs in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = words_of(raw)
                hit, found = scanner.hits(words)
                for a, b in runs or ():
                    hit[a:b] = True
                runs = runs_of(hit) if found or runs else []
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                names.append(sorted({str(scanner.names[k]) for k in found}.union(before or ())))
                spans.append(byte_ranges(raw, runs) if runs else [])
                all_runs.append(runs)
            pairs = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())),
                pa.array(spans, pairs), batch.column(1), pa.array(all_runs, pairs)], schema.names)
        return run

    return map_rows(rows, make, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The result columns of a scan, item names as one SHA-256 of their comma-joined list."""
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold any window of the benchmark."""
    block_bytes = options.get("block_bytes", BLOCK_BYTES)
    window = options.get("window", WINDOW)
    place = docs.columns.index(text)
    kept = docs
    for items in benchmark_blocks(benchmark, options.get("item", "item_id"),
                                  options.get("item_text", "text"), block_bytes):
        kept = _without(kept, items, place, window)
    return kept


def _without(docs: DataFrame, items: list[tuple], place: int, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        scanner = Scanner(shared.value, window)

        def run(batch):
            mask = [not scanner.hits(words_of((t or "").encode()))[1] for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))
        return run

    return map_rows(docs, make, docs.schema)
