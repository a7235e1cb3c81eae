"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its word shingles. ``collections`` small collections of ``per`` minimum
hashes each are computed, and a table key is a pair of collections: 16 collections of 3
give 120 tables of 6 hashes from 48 minimum hashes, where separate tables would take 720. Two
documents meet if any two collections agree, so a pair at similarity 0.8 is missed with
probability 2e-4, and one at 0.9 with less than 1e-7.

Documents with equal sets are one class, found by a digest of the set before any banding; only
one document of a class goes on. Collections that occur once are dropped before keys are formed.
Candidates are confirmed on full sets:

1. each bucket's members are held against its smallest document;
2. components are formed of the confirmed links;
3. in buckets that still hold several components, every pair of documents from different
   components is held against each other, unless shingles that one of them alone has rule the
   similarity out, or sketches of 512 bits do (at the similarity, for 4 pairs in a million).

So every pair that shares a bucket is confirmed or refuted, or known to be connected;
pairs inside a component are never listed. Nothing is capped.

Edge cases: null texts and texts without words have no shingles, link with nothing and are
kept; a row with a null id does the same; a text shorter than the shingle is one shingle. Rows
are told apart by their sets, so rows that share an id and have different texts are judged by their own
texts; equal rows are copies of each other. :func:`drop_near_duplicates` leaves one row of each
component and loses no other. Empty tables give empty tables; columns beyond the named ones are not
read, and handed on whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.batches import as_bytes, fresh_name, map_rows
from prefloom.llm.tables import beside, components, stored
from prefloom.llm.words import WordHashes, finish, shingles, split_words

SHINGLE = 5
PERCENT = 80
COLLECTIONS = 16
PER_COLLECTION = 3
CHUNK = 4096
SKETCH_BITS = 512


def min_hashes(values: np.ndarray, xors: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each hash function, its least value over ``values``."""
    best = None
    for i in range(0, len(values), CHUNK):
        low = ((values[None, i:i + CHUNK] ^ xors[:, None]) * factors[:, None]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best


def sketch(docs: DataFrame, doc_id: str, text: str, size: int, collections: int, per: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_a, set_b, parts``: set size, digest and hash collections."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("text_hash", T.LongType()),
        T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
        T.StructField("parts", T.ArrayType(T.LongType()))])

    def make():
        hashes = WordHashes()
        random = np.random.default_rng(7)
        draw = lambda: random.integers(0, 2**64, collections * per, np.uint64)
        xors, factors = draw(), draw() | np.uint64(1)

        def run(batch):
            counts, firsts, seconds, parts = [], [], [], []
            for raw in as_bytes(batch.column(2)):
                values = shingles(split_words(raw), hashes, size)
                counts.append(len(values))
                if not len(values):
                    firsts.append(None)
                    seconds.append(None)
                    parts.append(None)
                    continue
                digest = np.frombuffer(blake2b(values.tobytes(), digest_size=16).digest(), np.int64)
                firsts.append(int(digest[0]))
                seconds.append(int(digest[1]))
                low = min_hashes(values, xors, factors).reshape(collections, per)
                joint = np.zeros(collections, np.uint64)
                for k in range(per):
                    joint = finish(joint ^ low[:, k]) + np.uint64(k + 1)
                parts.append(joint.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64()),
                pa.array(seconds, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], schema.names)
        return run

    return map_rows(with_text_hash(docs, doc_id, text), make, schema)


def with_text_hash(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, text_hash, raw``: a row's id and hash tell its text from others of the same id."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(raw).alias("text_hash"), raw.alias("raw"))


def bucket_rows(classes: DataFrame, collections: int) -> DataFrame:
    """``key, j, rep, n``: the tables' rows, from collections that more than one class has.

    ``j`` is the later of the key's two collections.
    """
    parts = classes.select("rep", "n", F.posexplode("parts").alias("i", "c"))
    shared = parts.groupBy("i", "c").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    left = beside(parts, shared, ["i", "c"], ["rep"])
    held = left.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("p"))
    pairs = F.flatten(F.transform("p", lambda x, k: F.transform(
        F.slice("p", k + 2, collections), lambda y: F.struct(
            F.xxhash64(x["i"], y["i"], x["c"], y["c"]).alias("key"), y["i"].alias("j")))))
    return held.where(F.size("p") > 1).select(F.explode(pairs).alias("t"), "rep", "n").select("t.*", "rep", "n")


def close_sizes(a: str, b: str, percent: int) -> Column:
    """Sets of these sizes can reach the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets reach the similarity."""
    one = texts.select(F.col("rep").alias("a"), F.col("raw").alias("raw_a"))
    two = texts.select(F.col("rep").alias("b"), F.col("raw").alias("raw_b"))
    schema = pairs.select("a", "b").schema

    def make():
        hashes = WordHashes()
        last: list = [None, None]

        def run(batch):
            mask = []
            for a, raw_a, raw_b in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                if last[0] != a:
                    last[:] = a, shingles(split_words(raw_a), hashes, size)
                mine, other = last[1], shingles(split_words(raw_b), hashes, size)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                mask.append(both > 0 and 100 * both >= percent * (len(mine) + len(other) - both))
            keep = pa.array(mask, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
        return run

    return map_rows(pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "raw_a", "raw_b"), make, schema)


def own_counts(texts: DataFrame, size: int) -> DataFrame:
    """``rep, own``: how many shingles of a document no other one of ``texts`` has; absent if none."""
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("s", T.LongType())])

    def make():
        hashes = WordHashes()

        def run(batch):
            sets = [shingles(split_words(raw), hashes, size) for raw in as_bytes(batch.column(1))]
            at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(np.concatenate(sets).view(np.int64))], schema.names)
        return run

    single = map_rows(texts.select("rep", "raw"), make, schema).groupBy("s").agg(
        F.count(F.lit(1)).alias("m"), F.min("rep").alias("rep")).where("m = 1")
    return single.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))


def bit_sketches(texts: DataFrame, size: int) -> DataFrame:
    """``rep, b0 .. b7``: the low bits of 512 further minimum hashes, packed."""
    words = SKETCH_BITS // 64
    schema = T.StructType([T.StructField("rep", T.LongType()),
                           *[T.StructField(f"b{i}", T.LongType()) for i in range(words)]])

    def make():
        hashes = WordHashes()
        random = np.random.default_rng(23)
        draw = lambda: random.integers(0, 2**64, SKETCH_BITS, np.uint64)
        xors, factors = draw(), draw() | np.uint64(1)

        def run(batch):
            low = [min_hashes(shingles(split_words(raw), hashes, size), xors, factors) for raw in as_bytes(batch.column(1))]
            bits = np.packbits((finish(np.stack(low)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(bits[:, i]) for i in range(words)]], schema.names)
        return run

    return map_rows(texts.select("rep", "raw"), make, schema)


def most_differences(percent: int) -> int:
    """Differing sketch bits that a pair at the similarity stays within but for 4 in a million."""
    p = (1 - percent / 100) / 2
    return int(np.ceil(SKETCH_BITS * p + 4.5 * np.sqrt(SKETCH_BITS * p * (1 - p))))


def cross_pairs(buckets: DataFrame, comp: DataFrame, classes: DataFrame, texts: DataFrame, size: int,
                percent: int, collections: int) -> DataFrame:
    """Pairs of documents in one bucket but not in one component that may be similar.

    All but the bucket's largest component are held against the whole bucket, so a bucket
    with one large component and some strays gives pairs of strays only. A pair is taken in the
    first bucket it shares. Left out are pairs that cannot be similar:

    - shingles that no other open document has bound an overlap by the rest, ``f``; sets of sizes ``x``
      and ``y`` reach a similarity ``t`` only with an overlap of ``t (x + y) / (1 + t)``;
    - sketches that differ in more bits than :func:`most_differences`.
    """
    act = buckets.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key", "j", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    act = stored(act, "buckets")
    share = act.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
    major = share.groupBy("key").agg(
        F.max_by("comp", F.struct("m", "comp")).alias("major"), F.count(F.lit(1)).alias("k"), F.sum("m").alias("size"),
        F.min("least").alias("least"))
    # Buckets of two were settled when their members were held against each other.
    major = stored(major.where("k > 1 and size > 2").select("key", "major", "least"), "majors")
    held = stored(beside(act, major, ["key"], ["rep"]), "open")
    few = stored(texts.join(held.select("rep").distinct(), "rep", "left_semi"), "open-texts")
    facts = bit_sketches(few, size).join(own_counts(few, size), "rep", "left").join(classes.select("rep", "parts"), "rep")
    facts = stored(facts.withColumn("own", F.coalesce("own", F.lit(0))), "facts")
    reach = lambda a, b, f: percent * (F.col(a) + F.col(b)) <= (100 + percent) * f
    held = held.join(facts, "rep").withColumn("f", F.col("n") - F.col("own")).drop("own")
    held = stored(held.where(reach("n", "least", F.col("f"))), "open")
    bits = [f"b{i}" for i in range(SKETCH_BITS // 64)]
    minor = held.where("comp <> major").select(
        "key", F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("comp").alias("xc"), F.col("f").alias("xf"),
        F.col("parts").alias("xparts"), *[F.col(b).alias(f"x{b}") for b in bits])
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"x{b}"))) for b in bits), F.lit(0))
    earlier = sum((F.when((F.lit(k) < F.col("j")) & (F.get("parts", F.lit(k)) == F.get("xparts", F.lit(k))), 1).otherwise(0)
                   for k in range(collections)), F.lit(0))
    both = beside(held, minor, ["key"], ["rep"]).where(
        (F.col("comp") != F.col("xc")) & ((F.col("comp") == F.col("major")) | (F.col("x") < F.col("rep")))
        & close_sizes("n", "xn", percent) & reach("n", "xn", F.least("f", "xf"))
        & (differ <= most_differences(percent)) & (earlier == 1))
    return both.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def document_classes(sketches: DataFrame) -> DataFrame:
    """``rep, doc_id, text_hash, set_a, set_b, n, parts``: one row per different set, under a number ``rep``.

    ``doc_id`` is the smallest of the class, ``text_hash`` that of its text.
    """
    sets = sketches.where(F.col("set_a").isNotNull() & F.col("doc_id").isNotNull())
    classes = sets.groupBy("set_a", "set_b").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("n_shingles").alias("n"), F.first("parts").alias("parts"))
    # Numbers rise with the ids, so that all buckets of a group mostly agree on their smallest document;
    # they are written with the table and do not change later.
    return stored(classes.orderBy("of").select(F.monotonically_increasing_id().alias("rep"), "of.*", "set_a", "set_b", "n", "parts"), "classes")


def class_components(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, size: int, percent: int, collections: int) -> DataFrame:
    """``node, component`` of the classes that have a link, by their numbers."""
    buckets = stored(bucket_rows(classes, collections), "buckets")
    wanted = classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "text_hash")
    texts = stored(with_text_hash(docs, doc_id, text).join(wanted, ["doc_id", "text_hash"])
                   .dropDuplicates(["rep"]).select("rep", "raw"), "texts")
    pivots = buckets.groupBy("key").agg(
        F.min("rep").alias("pivot"), F.min_by("n", "rep").alias("pn"), F.count(F.lit(1)).alias("m")).where("m > 1")
    first = stored(beside(buckets, pivots.drop("m"), ["key"], ["rep"]).where(
        (F.col("rep") != F.col("pivot")) & close_sizes("n", "pn", percent)).select(
        F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = stored(confirmed(first, texts, size, percent), "confirmed")
    comp = components(links)
    second = cross_pairs(buckets, comp, classes, texts, size, percent, collections).join(first, ["a", "b"], "left_anti")
    more = stored(confirmed(stored(second, "pairs"), texts, size, percent), "confirmed")
    return components(links.union(more)) if more.limit(1).count() else comp


def judged_classes(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, collections: int, per: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, and per class ``doc_id, text_hash, set_a, set_b, component_id, chosen``.

    ``component_id`` is the smallest id of the component; one class that holds it is chosen.
    """
    sketches = stored(sketch(docs, doc_id, text, size, collections, per), "sketches")
    classes = document_classes(sketches)
    comp = class_components(docs, classes, doc_id, text, size, percent, collections)
    labelled = classes.select("rep", "doc_id", "text_hash", "set_a", "set_b").join(
        comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = stored(labelled, "labelled")
    first = labelled.groupBy("component").agg(F.min(F.struct("doc_id", "rep")).alias("first"))
    judged = beside(labelled, first, ["component"], ["rep"]).select(
        "doc_id", "text_hash", "set_a", "set_b", F.col("first.doc_id").alias("component_id"),
        (F.col("rep") == F.col("first.rep")).alias("chosen"))
    return sketches, stored(judged, "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    percent: int = PERCENT, collections: int = COLLECTIONS, per: int = PER_COLLECTION) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``; the smallest id of a component is kept."""
    sketches, judged = judged_classes(docs, doc_id, text, size, percent, collections, per)
    in_set = F.col("set_a").isNotNull() & F.col("doc_id").isNotNull()
    linked = sketches.where(in_set).select("doc_id", "n_shingles", "set_a", "set_b").join(
        judged.select("set_a", "set_b", "component_id"), ["set_a", "set_b"])
    alone = sketches.where(~in_set)
    return linked.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")).union(
        alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                         percent: int = PERCENT, collections: int = COLLECTIONS, per: int = PER_COLLECTION) -> DataFrame:
    """``docs`` with one row of each component; rows without words stay, of equal ones one, and all with a null id."""
    sketches, judged = judged_classes(docs, doc_id, text, size, percent, collections, per)
    kept = judged.where("chosen").select("doc_id", "text_hash").union(
        sketches.where("set_a is null and doc_id is not null").select("doc_id", "text_hash").distinct())
    h, i, k = (fresh_name(docs, name) for name in ("text_hash", "kept_id", "kept_hash"))
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
    kept = kept.select(F.col("doc_id").alias(i), F.col("text_hash").alias(k))
    same = (F.col(doc_id) == F.col(i)) & (F.col(h) == F.col(k))
    return keyed.join(kept, same, "left_semi").dropDuplicates([doc_id, h]).select(*docs.columns).union(
        docs.where(F.col(doc_id).isNull()))
