"""Interaction audit of document filters: what every order of them removes, step by step.

1. A narrow pass gives each text a mask with one bit per filter that it fails (A to D by its own
   words and characters) and a digest of its bytes; E, a copy of a smaller id, comes from the
   least id per digest.
2. Documents are counted into mask cells: ``part, mask, n, good, toxic``. All that follows depends
   on the cells only, of which a part has no more than two to the number of filters.
3. A recursive CTE starts from the masks that occur, extends each prefix of filters by every
   letter it does not hold yet, carries the bits applied so far, and each level says of each mask
   whether that step keeps, removes or no longer meets it. Its size depends on the
   number of filters alone (10,400 rows for five), so the counts of the cells are joined to
   it by mask, with the walk broadcast, and summed by part and prefix.

Edge cases: a null text is empty, a null part the empty string; a null id is no copy of anything
and nothing is a copy of it; rows with one id and text are not copies of each other (neither id
is smaller) and each count; a document with several label rows is good or toxic if any of them
says so; an empty table has no parts and gives no rows; columns beyond the named ones are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.batches import as_bytes, map_rows
from prefloom.llm.tables import stored

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
CAPITALS = bytes(range(0x41, 0x5B))
MARKS = b"#$%&*|"
# Bytes of a character after its first.
INNER = bytes(range(0x80, 0xC0))

RESULT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    words = raw.split()
    n = len(words)
    points = len(raw.translate(None, INNER))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2
            | (len(raw.translate(None, MARKS)) < len(raw)) << 3)


def facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id, part, mask, digest`` of every document."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                         F.col(text).cast("binary").alias("raw"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("part", T.StringType()),
                           T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def make():
        def run(batch):
            raws = as_bytes(batch.column(2))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([failures(r) for r in raws], pa.int32()),
                pa.array([blake2b(r, digest_size=16).digest() for r in raws], pa.binary())], schema.names)
        return run

    return map_rows(source, make, schema)


def labelled(found: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """:func:`facts` with ``good`` and ``toxic``; rows without an id need no look-up."""
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        yes(quality).alias("good"), yes(toxic).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    known = found.where("doc_id is not null").join(marks, "doc_id", "left").select(*found.columns, flag("good"), flag("toxic"))
    nameless = found.where("doc_id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.unionByName(nameless)


def mask_cells(flagged: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and the full set of filters they fail.

    Rows are counted by text, part and labels before they meet by text alone, so that the copies
    of one text, however many, are a row per part and label pair there.
    """
    group = ["digest", "part", "mask", "good", "toxic"]
    by_id = flagged.groupBy(*group, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    by_text = by_id.groupBy(*group).agg(
        F.sum("n").alias("n"), F.min(named).alias("first"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    originals = F.col("nameless") + F.coalesce(F.when(F.col("first.doc_id") == least, F.col("first.n")), F.lit(0))
    split = by_text.withColumn("own", originals).select(
        "part", "good", "toxic", F.inline(F.array(
            F.struct(F.col("mask"), F.col("own").alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("own")).alias("n")))))
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def walk(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``prefix, step, letter, mask, kept, removed, redundant, alone``: every prefix of distinct
    letters, and what its last filter does to documents of each mask in ``masks``."""
    choices = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(letters))
    return masks.sparkSession.sql(f"""
        WITH RECURSIVE walk(prefix, applied, step, letter, mask, kept, removed, redundant, alone) AS (
          SELECT '', 0, 0, '', mask, true, false, false, false FROM {{masks}}
          UNION ALL
          SELECT concat(w.prefix, u.letter), w.applied | u.bit, w.step + 1, u.letter, w.mask,
            (w.mask & (w.applied | u.bit)) = 0,
            (w.mask & u.bit) > 0 AND (w.mask & w.applied) = 0,
            (w.mask & u.bit) > 0 AND (w.mask & w.applied) > 0,
            w.mask = u.bit
          FROM walk w
          LATERAL VIEW inline(filter(array({choices}), c -> (w.applied & c.bit) = 0)) u AS letter, bit
          WHERE w.step < {len(letters)})
        SELECT * FROM walk WHERE step > 0""", masks=masks)


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Metrics of each step of each order, per part: the columns :data:`RESULT`."""
    cells = stored(cells, "cells")
    taken = stored(walk(cells.select("mask").distinct(), letters), "walk")
    total = lambda hit, c, name: F.coalesce(F.sum(F.when(F.col(hit), F.col(c))), F.lit(0)).cast("long").alias(name)
    # The cells and the walk meet by mask; the walk's size is fixed by the number of letters.
    steps = cells.join(F.broadcast(taken), "mask").groupBy("part", "prefix", "step", "letter").agg(
        total("kept", "n", "kept"), total("removed", "n", "removed"), total("redundant", "n", "redundant"),
        total("alone", "n", "unique_fails"), total("removed", "good", "good_lost"), total("removed", "toxic", "toxic_lost"))
    # A prefix opens as many orders as its missing letters have permutations.
    opened = F.col("removed") * F.factorial(F.lit(len(letters)) - F.col("step"))
    steps = steps.withColumn("shapley", F.sum(opened).over(Window.partitionBy("part", "letter")))
    orders = taken.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    places = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("k")).select(
        "filter_order", F.expr("left(filter_order, k)").alias("prefix"))
    return steps.join(F.broadcast(places), "prefix").select(*RESULT)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole tables."""
    return audit(mask_cells(labelled(stored(facts(docs), "filter-facts"), labels)))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (
  SELECT filter_order, k AS step, bits[k] AS bit, list_sum(bits[1:k])::INT AS upto, list_sum(bits[1:k])::INT - bits[k] AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS k)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & upto = 0) AS kept,
    sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost,
    sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r"""
