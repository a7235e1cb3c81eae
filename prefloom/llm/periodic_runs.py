"""Periodic runs of words, found on an enhanced suffix array with the branching-tandem test.

A run is a stretch of words with smallest period ``q``, of ``min_length`` and ``2 q`` words or more,
that neither neighbour extends. Per text:

1. Words become numbers. In a run of enough length each word lies in a gram of half that length
   that is there again one period on, so words outside repeated grams are left out without loss;
   the rest is one sequence, its parts divided by numbers that occur once.
2. Suffix array, its inverse and the common prefixes of neighbours (LCP) are made. Each LCP value
   stands for an interval whose two halves meet there with that value as depth. The suffixes
   of the smaller half are tested: suffix ``i`` and ``i + depth`` (or ``i - depth``) lie on
   either side, by their places in the inverse array, exactly if a square of that period ends
   where it can be shifted no further to the right. There are no tree nodes, only ranges.
3. Such squares are rotated to the left as far as words agree, which gives the run; a square inside
   a run of a smaller period with the same end is a power of it and adds nothing.

The work is n log n a text and independent of other texts; a table's rows are one narrow pass.

Edge cases: null and empty texts have no words, no runs and an empty rest; a null id is kept; rows
are judged each on their own, repeated ones alike; an empty table gives an empty table; columns
beyond the named ones are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.batches import as_bytes, map_rows

MIN_LENGTH = 12
TESTED = 1 << 20  # suffixes tested at a time
MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of positive numbers, and its inverse, by prefix doubling."""
    n = len(s)
    bits = int(s.max()).bit_length()
    k = max(1, 62 // bits)
    padded = np.concatenate([s, np.zeros(k, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(k):
        key = (key << bits) | padded[i:n + i]
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.concatenate([[True], key[1:] != key[:-1]])
    slots = np.arange(n)
    rank = np.full(n + 1, -1, np.int64)  # the empty suffix comes before all others
    rank[order] = np.maximum.accumulate(np.where(start, slots, 0))
    while True:
        alone = start & np.append(start[1:], True)
        slots, sub = slots[~alone], order[slots[~alone]]
        if not len(slots):
            return order, rank[:-1]
        # A suffix that ends before the compared part does is like no other, so sub + k is n at most.
        key = (rank[sub] << 31) + rank[sub + k] + 1
        by = np.argsort(key, kind="stable")
        key, sub = key[by], sub[by]
        order[slots] = sub
        start = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sub] = np.maximum.accumulate(np.where(start, slots, 0))
        k *= 2


def common_prefixes(s: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Length of what each suffix shares with the one before it in order."""
    n, h = len(s), 0
    out = [0] * n
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            end = n - max(i, j)
            while h < end and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def halves(lcp: list[int]) -> list[tuple[int, int, int, int]]:
    """``low, border, high, depth`` of each positive LCP value: suffixes ``low`` to ``border - 1`` and
    ``border`` to ``high - 1`` share ``depth`` words, within either half at least as many."""
    found, stack = [], []  # stack: (border, low), of rising depth
    for i, depth in enumerate([*lcp, 0]):
        low = i - 1
        while stack and lcp[stack[-1][0]] >= depth:
            border, low = stack.pop()
            if lcp[border]:
                found.append((low, border, i, lcp[border]))
        stack.append((i, low))
    return found


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the squares that cannot be shifted to the right."""
    order, rank = suffix_array(s)
    n = len(s)
    lcp = common_prefixes(s.tolist(), order.tolist(), rank.tolist())
    ranges = np.array(halves(lcp), np.int64).reshape(-1, 4)
    low, border, high, depth = ranges.T
    left = border - low <= high - border
    first, size = np.where(left, low, border), np.where(left, border - low, high - border)
    other, other_end = np.where(left, border, low), np.where(left, high, border)
    places, periods = [], []
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + TESTED, "right")))
        w = size[a:b]
        node = np.repeat(np.arange(a, b), w)
        at = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + first[node]
        i, d = order[at], depth[node]
        for shift in (d, -d):
            there = i + shift
            inside = (there >= 0) & (there < n)
            r = rank[np.where(inside, there, 0)]
            hit = inside & (r >= other[node]) & (r < other_end[node])
            places.append(np.minimum(i, there)[hit])
            periods.append(d[hit])
        a = b
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.zeros(0, np.int64),) * 2


def leftmost(s: np.ndarray, i: int, q: int) -> int:
    """The least start from which words agree with those ``q`` on, up to ``i``."""
    step = 16
    while i:
        low = max(0, i - step)
        unlike = np.flatnonzero(s[low:i] != s[low + q:i + q])
        if len(unlike):
            return low + int(unlike[-1]) + 1
        i, step = low, step * 4
    return 0


def merged(s: np.ndarray, places: np.ndarray, periods: np.ndarray, min_length: int) -> list[Run]:
    """The runs that squares belong to, as ``start, length, period``."""
    ends = places + 2 * periods
    runs, last, starts = [], -1, []
    for k in np.lexsort((periods, ends)).tolist():
        i, q, end = int(places[k]), int(periods[k]), int(ends[k])
        if end != last:
            last, starts = end, []
        if any(i >= start for start in starts):
            continue  # a power of a shorter period that ends here too
        start = leftmost(s, i, q)
        starts.append(start)
        if end - start >= min_length:
            runs.append((start, end - start, q))
    return runs


def repeated_parts(ids: np.ndarray, gram: int) -> np.ndarray:
    """Which words lie in a gram that is there more than once."""
    n = len(ids) - gram + 1
    covered = np.zeros(len(ids), bool)
    if n < 2:
        return covered
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for k in range(gram):
            key = (key ^ ids[k:n + k]) * MIX
            key ^= key >> np.uint64(29)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return covered
    change = np.zeros(len(ids) + 1, np.int64)
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    np.add.at(change, at, 1)
    np.add.at(change, at + gram, -1)
    return np.cumsum(change[:-1]) > 0


def find_runs(words: list, min_length: int = MIN_LENGTH) -> list[Run]:
    """All runs of a list of words as ``start, length, period``, by start, then period."""
    if len(words) < min_length:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    covered = repeated_parts(ids.view(np.uint64), (min_length + 1) // 2)
    if not covered.any():
        return []
    # The first word after a covered part stays as that part's end, by a number of its own.
    ended = np.concatenate([[False], covered[:-1] & ~covered[1:]])
    at = np.flatnonzero(covered | ended)
    s = ids[at] + 1
    bare = ~covered[at]
    s[bare] = len(number) + 1 + np.arange(int(bare.sum()))
    s = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    return sorted((int(at[start]), length, q) for start, length, q in merged(s, *branching_squares(s), min_length))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def with_period(doc_id, words: list) -> list:
    """``words``, or for one id in ten its words with a repeated stretch from some word on."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turns, rest = divmod(n - a, p)
    return words[:a] + words[a:a + p] * turns + words[a:a + rest]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                  prepare: Callable[[object, list], list] | None = None) -> DataFrame:
    """Per document ``doc_id, runs, collapsed``: its runs by start and period, and the text without
    what repeats in them, words joined by one space. ``prepare`` may change a document's words before."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([source.schema["doc_id"], T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())])
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def make():
        def run(batch):
            found, left = [], []
            for name, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = raw.split()
                if prepare:
                    words = prepare(name, words)
                runs = find_runs(words, min_length)
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                left.append(b" ".join(collapsed(words, runs)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow), pa.array(left, pa.string())], schema.names)
        return run

    return map_rows(source, make, schema)


def digest(found: DataFrame) -> DataFrame:
    """Count of runs, the longest one and digests of :func:`periodic_runs`."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("_l", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_l.s")).alias("start"),
        F.col("_l.length").alias("length"), (-F.col("_l.p")).alias("period"),
        F.expr("1000 * _l.length div -_l.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
