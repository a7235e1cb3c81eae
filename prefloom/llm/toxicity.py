"""Toxicity scores: boosted trees over dense text features, calibrated isotonically.

The lexicon is learned: words and word beginnings of labelled rows, kept if they are far more
frequent among toxic documents. Features are the lexicon's densities, how near its hits are to
the second person, and rates of capitals, punctuation and obfuscated words.

Fitting uses at most ``fit_rows`` labelled rows, the first by a hash of the id (a stated bound);
their texts are read by a broadcast join with those ids. Lexicon counts are made by Spark over that
sample, and only features and the chosen lexicon (at most ``lexicon_size`` entries) reach the
driver. Every document is then scored whole, in one pass without a shuffle.

Edge cases: a null or empty text has no words and gets the score of its (zero) features;
without usable labels of both kinds every score is the share of toxic labels, 0.5 if there are none.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.batches import as_bytes, map_rows
from prefloom.llm.boosting import CalibratedTrees
from prefloom.llm.labelled import CLASSES, byte_counts, held_out, sample_labels
from prefloom.llm.tables import stored

FIT_ROWS = 12_000
LEXICON_SIZE = 2_000
CUTOFF = 0.5
PREFIXES = (3, 4, 5, 6, 8)
SECOND_PERSON = set(
    "you your yours yourself u ur ya du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros".split())
LEET = bytes.maketrans(b"013457@$", b"oieastas")
EDGE = re.compile(rb"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")
INNER = re.compile(rb"[A-Za-z][0-9@$*._\-][A-Za-z]")
CACHED_WORDS = 300_000
FEATURES = ["log_words", "hits", "density", "weight", "strongest", "kinds", "near", "second", "caps_words", "obfuscated",
            *CLASSES]


def plain(word: bytes) -> bytes:
    """A word without outer punctuation, small, with digits read as the letters they look like."""
    return EDGE.sub(b"", word).lower().translate(LEET)


def units(word: bytes) -> list[str]:
    """The word and its beginnings, as lexicon entries."""
    text = word.decode("utf-8", "replace")
    return [f"={text}"] + [text[:k] for k in PREFIXES if len(text) >= k]


def count_units(sample: DataFrame) -> DataFrame:
    """``unit, toxic, clean``: in how many documents of each label it occurs; summed in tasks first."""

    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for raw, label in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                found = {u for w in {plain(w) for w in raw.split()} if w for u in units(w)}
                (toxic if label else clean).update(found)
            if len(toxic) + len(clean) > 500_000:
                yield _counts(toxic, clean)
                toxic, clean = Counter(), Counter()
        yield _counts(toxic, clean)

    rows = sample.select("raw", "label").mapInArrow(run, "unit string, toxic long, clean long")
    return rows.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counts(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    names = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays([
        pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
        pa.array([clean[n] for n in names], pa.int64())], ["unit", "toxic", "clean"])


def learn_lexicon(sample: DataFrame, size: int) -> dict[str, float]:
    """Entries that set toxic documents apart, with their log odds; at most ``size``."""
    totals = dict(sample.groupBy("label").agg(F.count(F.lit(1))).collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    a, b = F.col("toxic"), F.col("clean")
    both = a + b
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share = bad / (bad + good)
    gain = 2 * (part(a, both * share) + part(b, both * (1 - share)))
    odds = F.log((a + 0.5) / (bad - a + 0.5)) - F.log((b + 0.5) / (good - b + 0.5))
    found = count_units(sample).select("unit", gain.alias("gain"), odds.alias("odds"), "toxic").where(
        "toxic >= 3 and odds > 1.5 and gain > 14").orderBy(F.desc("gain"), "unit").limit(size)
    return {r["unit"]: r["odds"] for r in found.collect()}


class Featurizer:
    """Dense features of texts, given a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        names = sorted(lexicon)
        place = {n: i + 1 for i, n in enumerate(names)}
        self.weights = np.array([0.0, *(lexicon[n] for n in names)])

        class Codes(dict):
            """A word's best lexicon entry, then flags: second person, capitals, obfuscated."""

            def __missing__(self, word: bytes) -> int:
                if len(self) >= CACHED_WORDS:
                    self.clear()
                base = plain(word)
                entries = [u for u in units(base) if u in place] if base else []
                code = place[max(entries, key=lexicon.get)] << 3 if entries else 0
                code |= base.decode("utf-8", "replace") in SECOND_PERSON
                code |= 2 * (len(base) > 2 and word.isupper())
                code |= 4 * bool(INNER.search(word))
                self[word] = code
                return code

        self.codes = Codes()

    def row(self, raw: bytes) -> np.ndarray:
        words = raw.split()
        n = len(words)
        out = np.zeros(len(FEATURES))
        if not n:
            return out
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, n)
        entry = codes >> 3
        at = np.flatnonzero(entry)
        weight = self.weights[entry[at]]
        you = np.flatnonzero(codes & 1)
        near = 0.0
        if len(at) and len(you):
            right = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(you[np.maximum(right - 1, 0)] - at))
            near = 1.0 / (1.0 + gap.min())
        out[:10] = (np.log1p(n), len(at), len(at) / n, weight.sum() / n, weight.max(initial=0.0), len(np.unique(entry[at])),
                    near, len(you) / n, np.count_nonzero(codes & 2) / n, np.count_nonzero(codes & 4) / n)
        out[10:] = byte_counts(raw) / len(raw)
        return out

    def matrix(self, texts: list[bytes]) -> np.ndarray:
        return np.stack([self.row(t) for t in texts]) if texts else np.zeros((0, len(FEATURES)))


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: CalibratedTrees | None
    share: float

    def scores(self, featurizer: Featurizer, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return self.trees.probability(featurizer.matrix(texts))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        fit_rows: int = FIT_ROWS, lexicon_size: int = LEXICON_SIZE) -> ToxicityModel:
    """A model of the labels, from at most ``fit_rows`` rows outside the held-out fold."""
    few = sample_labels(labels, doc_id, label, fit_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    joined = rows.join(F.broadcast(few), "doc_id")
    # Copies of one text would make all of its words look telling.
    sample = stored(joined.groupBy(F.xxhash64("raw").alias("same"), "label").agg(
        F.first("raw").alias("raw"), F.min("doc_id").alias("doc_id")).drop("same"), "labelled")
    lexicon = learn_lexicon(sample, lexicon_size)

    def make():
        featurizer = Featurizer(lexicon)

        def run(batch):
            matrix = featurizer.matrix(as_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(matrix))], ["doc_id", "label", "x"])
        return run

    schema = T.StructType([sample.schema["doc_id"], T.StructField("label", T.IntegerType()),
                           T.StructField("x", T.ArrayType(T.DoubleType()))])
    # Bounded: fit_rows rows of a fixed number of features.
    table = map_rows(sample.select("raw", "doc_id", "label"), make, schema).toPandas()
    table = table.sort_values("doc_id", kind="stable")
    y = table["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(lexicon, None, float(y.mean()) if len(y) else 0.5)
    return ToxicityModel(lexicon, CalibratedTrees().fit(np.stack(table["x"]), y), float(y.mean()))


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text",
          cutoff: float = CUTOFF) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def make():
        fitted = shared.value
        featurizer = Featurizer(fitted.lexicon)

        def run(batch):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fitted.scores(featurizer, as_bytes(batch.column(1))))], schema.names)
        return run

    return map_rows(source, make, schema).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without those that score ``cutoff`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def make():
        fitted = shared.value
        featurizer = Featurizer(fitted.lexicon)

        def run(batch):
            texts = [(t or "").encode() for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(fitted.scores(featurizer, texts) < cutoff))
        return run

    return map_rows(docs, make, docs.schema)
