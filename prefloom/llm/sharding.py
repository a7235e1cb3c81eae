"""Sharding by extendible hashing, in DataFrame functions only.

Every row has a 60-bit hash. The directory starts with one bucket for all; a bucket over the byte
limit, and no other, is split on the next bit, until every bucket fits. Splitting is done
on sums of bytes by hash prefix, ``step`` bits a round:

1. bytes are summed by the prefix of a round's last bit (partial sums in each task, at most
   ``2**step`` groups below an open bucket); sums of the shorter prefixes follow from these;
2. a prefix is a bucket if it fits and its parent does not;
3. prefixes still too large at the round's last bit stay open, and the next round reads only
   their rows.

Rows find their bucket by joining each round's directory on their prefix. A directory has one row
for each prefix in use, never the rows of one; it is joined as a table and broadcast only
if the optimizer measures it small.

Edge cases: a null text has no bytes; null ids hash like empty ones. A single row over the limit
cannot be split: it gets a shard of its own, and ``fits`` is false. Rows with equal id and text have
equal hashes, so they share a shard whatever their bytes (``fits`` tells). An empty table
gives an empty table. Other columns come along untouched; those named like a result are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.batches import fresh_name
from prefloom.llm.tables import stored

BITS = 60
STEP = 12
SHARD_BYTES = 64_000_000
ADDED = ["n_bytes", "shard", "shard_bytes", "shard_rows", "fits"]


def row_hash(doc_id: str, text: str) -> Column:
    """60 bits of a digest of id and text, as a number of zero or more."""
    whole = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def directory(slots: DataFrame, limit: int, step: int = STEP) -> list[tuple[int, DataFrame]]:
    """Per round its last bit and table ``prefix, depth, shard_bytes, shard_rows``.

    ``slots`` has ``h`` and ``n_bytes``. ``depth`` is how many leading bits name the bucket of a
    prefix; prefixes whose bucket is still open are left to the next round.
    """
    rounds, base = [], 0
    while True:
        last = min(base + step, BITS)
        sums = stored(slots.groupBy(F.shiftright("h", BITS - last).alias("prefix")).agg(
            F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "prefix-sums")
        each = sums.select("prefix", "bytes", "rows", F.explode(F.sequence(F.lit(base), F.lit(last))).alias("depth"))
        each = each.withColumn("part", F.expr(f"shiftright(prefix, {last} - depth)"))
        nodes = each.groupBy("depth", "part").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
        # Of the prefixes that fit, a row's bucket is the shortest: its parent does not fit.
        found = each.select("prefix", "depth", "part").join(nodes.where(fits), ["depth", "part"]).groupBy("prefix").agg(
            F.min_by(F.struct("depth", "shard_bytes", "shard_rows"), "depth").alias("b")).select("prefix", "b.*")
        found = stored(found, "directory")
        rounds.append((last, found))
        left = sums.join(found, "prefix", "left_anti").select("prefix")
        if last == BITS or not left.limit(1).count():
            return rounds
        slots = stored(slots.withColumn("prefix", F.shiftright("h", BITS - last)).join(left, "prefix", "left_semi")
                       .select("h", "n_bytes"), "open-rows")
        base = last


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES,
           step: int = STEP, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with each row's shard.

    Added are ``n_bytes``, ``shard`` (leading bits of the row's hash, as text), ``shard_bytes``,
    ``shard_rows`` and ``fits``.
    """
    keep = docs.columns if keep is None else keep
    if clash := {c.lower() for c in keep} & set(ADDED):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    h, p, b, e = (fresh_name(docs, n) for n in ("_h", "_p", "_b", "_entry"))
    rows = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                       row_hash(doc_id, text).alias(h), F.lit(None).cast("struct<depth:int,shard_bytes:bigint,shard_rows:bigint>").alias(b))
    for last, found in directory(rows.select(F.col(h).alias("h"), "n_bytes"), limit, step):
        entry = found.select(F.col("prefix").alias(p), F.struct("depth", "shard_bytes", "shard_rows").alias(e))
        rows = rows.withColumn(p, F.shiftright(h, BITS - last)).join(entry, p, "left").withColumn(
            b, F.coalesce(b, e)).drop(p, e)
    bits = F.substring(F.lpad(F.bin(h), BITS, "0"), F.lit(1), F.col(b)["depth"])
    return rows.select(*keep, "n_bytes", bits.alias("shard"), F.col(b)["shard_bytes"].alias("shard_bytes"),
                       F.col(b)["shard_rows"].alias("shard_rows"), (F.col(b)["shard_bytes"] <= limit).alias("fits"))


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """``docs`` written below ``path``, a folder per shard; returns the manifest of shards.

    Rows are dealt by shard, so a shard is one file and a task holds whole shards of bounded bytes.
    """
    rows = assign(docs, **options)
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.option("basePath", path).schema(rows.schema).parquet(path)
    return written.groupBy("shard").agg(F.count(F.lit(1)).alias("shard_rows"), F.sum("n_bytes").alias("shard_bytes"))


ORACLE = f"""
WITH slots AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
parts AS (
  SELECT r, d, n_bytes, h >> ({BITS} - d) AS part
  FROM (SELECT r, h, n_bytes, unnest(range(0, {BITS} + 1)) AS d FROM slots)),
sums AS (SELECT d, part, sum(n_bytes) AS b, count(*) AS n FROM parts GROUP BY d, part),
chosen AS (
  SELECT r, min_by(d, d) AS d, min_by(b, d) AS b, min_by(n, d) AS n
  FROM parts JOIN sums USING (d, part) WHERE b <= {SHARD_BYTES} OR n = 1 OR d = {BITS} GROUP BY r)
SELECT doc_id, n_bytes, substr(lpad(bin(h), {BITS}, '0'), 1, CAST(d AS INTEGER)) AS shard, CAST(b AS BIGINT) AS shard_bytes,
       n AS shard_rows, b <= {SHARD_BYTES} AS fits
FROM slots JOIN chosen USING (r)
"""
