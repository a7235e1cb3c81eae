"""Removal of repeated substrings over a whole corpus.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else. Texts are
judged as they come in, as UTF-8 bytes, and matches never cross documents.

1. Each window of ``length`` bytes is named after its least 32-byte gram (by hash, leftmost of
   equals). Equal windows have equal names, and neighbouring windows mostly share the gram, so
   a text falls into segments of about 85 windows.
2. Names that one segment only has cannot repeat and go. Equal segments are counted as one.
   A segment that is there twice or more is repeated as a whole.
3. Names with several different segments go to :func:`prefloom.llm.bwt.repeated`: blocks of whole
   names, of a few megabytes, each by interval expansion on a Burrows-Wheeler transform.
   A name with more bytes than a block may have is dealt by its windows' digests instead, which
   says the same, so that no name is ever one task's load.
4. Ranges come back to their documents.

Equal segments and windows are told by 128 bits of hash. Documents are told apart by id and
text together, so repeated ids do no harm; rows equal in both repeat each other.

Edge cases: a null text is empty; texts shorter than ``length`` lose nothing; null ids are ids
like any other; an empty table gives an empty table; other columns may have any names. Where removal parts a character,
:func:`drop_repeats` drops its remaining bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.batches import as_bytes, fresh_name, map_rows
from prefloom.llm.bwt import repeated
from prefloom.llm.tables import beside, stored

LENGTH = 200
GRAM = 32
SPAN = 1 << 20  # windows named at a time; places in a span take 24 bits of the compared number
BLOCK_BYTES = 1_000_000
NAME_BYTES = 4_000_000
TASK_BYTES = 3_000_000
PLACE = np.uint64((1 << 24) - 1)


class Namer:
    """Splits a text into segments of windows with one name."""

    def __init__(self, length: int):
        random = np.random.default_rng(11)
        draw = lambda n: random.integers(0, 2**64, n, np.uint64) | np.uint64(1)
        self.letters, self.factors = draw(256), draw(8)
        self.gram = min(GRAM, 1 << (length.bit_length() - 1))
        self.length = length

    def segments(self, raw: bytes):
        """Arrays ``name, first window, number of windows`` of each segment."""
        count = len(raw) - self.length + 1
        data = np.frombuffer(raw, np.uint8)
        for start in range(0, max(count, 0), SPAN):
            n = min(SPAN, count - start)
            yield from self._span(data[start:start + n + self.length - 1], start, n)

    def _span(self, data: np.ndarray, start: int, n: int):
        h, k, f = self.letters[data], 1, 0
        while k < self.gram:
            h = h[:-k] * self.factors[f] + h[k:]
            k, f = 2 * k, f + 1
        h ^= h >> np.uint64(32)
        h *= self.factors[7]
        low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        width = self.length - self.gram + 1
        k = 1
        while 2 * k <= width:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < width:
            low = np.minimum(low[:k - width], low[width - k:])
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(np.append(first, n))
        yield h[(low[first] & PLACE).astype(np.int64)].view(np.int64), first + start, size


def row_key() -> Column:
    return F.xxhash64("doc_id", "raw")


def source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, raw, row``: the text's bytes, and a hash of both for telling rows apart."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(doc_id).alias("doc_id"), raw.alias("raw")).withColumn("row", row_key())


def segment_rows(src: DataFrame, length: int) -> DataFrame:
    """``name, digest, doc_id, row, first, size``: the segments of every text."""
    schema = T.StructType([
        T.StructField("name", T.LongType()), T.StructField("digest", T.LongType()), src.schema["doc_id"],
        T.StructField("row", T.LongType()), T.StructField("first", T.LongType()), T.StructField("size", T.IntegerType())])

    def make():
        namer = Namer(length)
        sign = xxhash.xxh3_64_intdigest

        def run(batch):
            owners, names, digests, firsts, sizes = [], [], [], [], []
            for i, raw in enumerate(as_bytes(batch.column(1))):
                for name, first, size in namer.segments(raw):
                    names.append(name)
                    firsts.append(first)
                    sizes.append(size)
                    owners.append(np.full(len(name), i))
                    ends = (first + size + (length - 1)).tolist()
                    digests.append(np.fromiter((sign(raw[a:b]) for a, b in zip(first.tolist(), ends)), np.uint64, len(ends)))
            if names:
                at = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(names)), pa.array(np.concatenate(digests).view(np.int64)),
                    batch.column(0).take(at), batch.column(2).take(at), pa.array(np.concatenate(firsts), pa.int64()),
                    pa.array(np.concatenate(sizes), pa.int32())], schema.names)
        return run

    return map_rows(src, make, schema)


def same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def pieces(src: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """``name, digest, place, piece``: the bytes of chosen segments, or, for names that are
    too large for a block, the digest of each of their windows with its place."""
    per_row = chosen.groupBy("doc_id", "row").agg(F.collect_list(
        F.struct("name", "digest", "first", "size", F.col("large").cast("int").alias("large"))).alias("parts"))
    joined = src.alias("s").join(per_row.alias("p"), same_row("s", "p")).select("s.raw", "p.parts")
    schema = "name long, digest long, place int, piece binary"

    def make():
        def run(batch):
            rows = []
            for raw, parts in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                for p in parts:
                    a, n = p["first"], p["size"]
                    if p["large"]:
                        rows += [(p["name"], p["digest"], i, xxhash.xxh3_128_digest(raw[a + i:a + i + length])) for i in range(n)]
                    else:
                        rows.append((p["name"], p["digest"], -1, raw[a:a + n + length - 1]))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
                    pa.array(columns[3], pa.binary())], ["name", "digest", "place", "piece"])
        return run

    return map_rows(joined, make, schema)


def expanded(blocks: DataFrame, length: int) -> DataFrame:
    """``name, digest, spans``: repeated byte ranges within segments; ``blocks`` is sorted by name."""
    schema = "name long, digest long, spans array<int>"

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for name, digest, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if name != last and size >= BLOCK_BYTES:
                    yield from _block(held, length)
                    held, size = [], 0
                held.append((name, digest, piece))
                size, last = size + len(piece), name
        yield from _block(held, length)

    return blocks.select("name", "digest", "piece").mapInArrow(run, schema)


def _block(rows: list[tuple], length: int):
    names, digests, spans = [], [], []
    for (name, digest, _), again in zip(rows, repeated([r[2] for r in rows], length) if rows else ()):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
        if len(edge):
            edge[1::2] += length - 1
            names.append(name)
            digests.append(digest)
            spans.append(edge.astype(np.int32))
    if names:
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.int64()), pa.array(digests, pa.int64()), pa.array(spans, pa.list_(pa.int32()))],
            ["name", "digest", "spans"])


def repeated_spans(src: DataFrame, length: int, name_bytes: int = NAME_BYTES) -> DataFrame:
    """``doc_id, row, spans``: per document, its repeated ranges as ``start, end`` pairs, unordered."""
    spark = src.sparkSession
    segments = stored(segment_rows(src, length), "segments")
    twice = segments.groupBy("name").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("name")
    live = stored(beside(segments, twice.hint("shuffle_hash"), ["name"], ["row", "first"]), "live")
    distinct = stored(live.groupBy("name", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct("doc_id", "row", "first")).alias("at"), F.first("size").alias("size")), "distinct")
    several = distinct.groupBy("name").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("size") + (length - 1)).alias("bytes")).where("k > 1")
    several = stored(several.select("name", "bytes", (F.col("bytes") > name_bytes).alias("large")), "names")
    chosen = stored(beside(distinct, several, ["name"], ["digest"]).select(
        "name", "digest", "n", "at.*", "size", "large"), "chosen")
    cut = stored(pieces(src, chosen, length), "pieces")

    total = several.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))
    small = cut.where("place < 0").repartition(tasks, "name").sortWithinPartitions("name")
    windows = cut.where("place >= 0")
    again = windows.groupBy("name", "piece").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("name", "piece")
    apart = beside(windows, again, ["name", "piece"], ["digest"]).groupBy("name", "digest").agg(
        F.flatten(F.collect_list(F.array("place", F.col("place") + length))).alias("spans"))
    found = expanded(small, length).union(apart)

    # A segment that is there once is its own example; those there more often are repeated whole.
    once = chosen.where("n = 1").join(found, ["name", "digest"]).select(
        "doc_id", "row", F.transform("spans", lambda x: x + F.col("first")).alias("spans"))
    whole = beside(live, distinct.where("n > 1").select("name", "digest"), ["name", "digest"], ["row", "first"]).select(
        "doc_id", "row", F.array(F.col("first"), F.col("first") + F.col("size") + (length - 1)).alias("spans"))
    return once.union(whole).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept_bytes(raw: bytes, spans: list[int] | None) -> tuple[bytes, int, int]:
    """What is left of ``raw`` without the ranges, the number of bytes removed and of runs."""
    if not spans:
        return raw, 0, 0
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    src = source(docs, doc_id, text)
    spans = repeated_spans(src, length, **options)
    schema = T.StructType([
        src.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def make():
        def run(batch):
            rows = []
            for raw, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                left, removed, runs = kept_bytes(raw, spans)
                rows.append((len(raw), removed, runs, hashlib.sha256(left).hexdigest()))
            size, removed, runs, sha = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()), pa.array(sha)], schema.names)
        return run

    joined = src.alias("s").join(spans.alias("p"), same_row("s", "p"), "left").select("s.doc_id", "s.raw", "p.spans")
    return map_rows(joined, make, schema)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with repeated ranges taken out of ``text``; other columns as they are."""
    src = source(docs, doc_id, text)
    spans = repeated_spans(src, length, **options)
    row, name, i, r = (fresh_name(docs, n) for n in ("_row", "_spans", "_i", "_r"))
    keyed = docs.withColumn(row, F.xxhash64(doc_id, F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
    found = spans.select(F.col("doc_id").alias(i), F.col("row").alias(r), F.col("spans").alias(name))
    joined = keyed.join(found, F.col(doc_id).eqNullSafe(F.col(i)) & (F.col(row) == F.col(r)), "left").select(
        *docs.columns, name)
    names = docs.columns
    place = names.index(text)

    def make():
        def run(batch):
            texts = []
            for value, spans in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if value is not None and spans:
                    value = kept_bytes(value.encode(), spans)[0].decode("utf-8", "ignore")
                texts.append(value)
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)
        return run

    return map_rows(joined, make, docs.schema)
