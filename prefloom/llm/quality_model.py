"""Quality scores from positive-unlabelled learning with the non-negative risk.

A small network over dense text features is fitted on trusted positives and unlabelled web text.
With class prior ``p`` and logistic loss, the risk is ``p R+(positives)`` plus what is left of the
unlabelled texts' negative risk without the positives' share, held at zero or more; where that
remainder is negative, its gradient is followed upward instead. Negative labels are never read.

The prior is estimated: a classifier of positives against unlabelled texts is fitted on one
half of the sample, and on the other half the least ratio of the unlabelled to the positive
share above a threshold, less its error, bounds the share of positives among the unlabelled.

At most ``fit_rows`` labelled rows and as many unlabelled ones are used, the first by a hash of
the id (a stated bound); texts are reached by a broadcast join with those ids, and only features come
to the driver. Every document is then scored whole, in one pass without a shuffle.

Edge cases: null and empty texts get the score of zero features; without positives or without
unlabelled texts every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.batches import as_bytes, map_rows
from prefloom.llm.boosting import sigmoid
from prefloom.llm.labelled import CLASSES, byte_counts, held_out, sample_labels

FIT_ROWS = 10_000
CUTOFF = 0.3
ZIP_BYTES = 1 << 16
SYMBOLS = re.compile(rb"[#*$%&|<>!]{1,}")
FEATURES = ["log_words", "word_length", "kinds", "same_lines", "same_next", "top_word", "marked", "alone", "long_words",
            "packed", "words_a_line", *CLASSES]


def features(raw: bytes) -> np.ndarray:
    """Dense features of one text."""
    out = np.zeros(len(FEATURES))
    words = raw.split()
    n = len(words)
    if not n:
        return out
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same_next = sum(map(bytes.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, n)
    marks = len(SYMBOLS.findall(raw))
    packed = sum(len(zlib.compress(raw[i:i + ZIP_BYTES], 1)) for i in range(0, len(raw), ZIP_BYTES))
    out[:11] = (np.log1p(n), lengths.mean(), np.log(len(counts)) / np.log1p(n), 1 - len(set(lines)) / max(len(lines), 1),
                same_next / n, max(counts.values()) / n, marks / n, counts.get(b"|", 0) / n, np.mean(lengths > 20),
                packed / len(raw), np.log1p(n / max(len(lines), 1)))
    out[11:] = byte_counts(raw) / len(raw)
    return out


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, len(FEATURES)))


class Network:
    """One hidden layer and a logit; trained by Adam."""

    def __init__(self, width: int, hidden: int, seed: int):
        random = np.random.default_rng(seed)
        self.p = [random.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden),
                  random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float, decay: float) -> None:
        """Follow the gradient whose part at each logit is ``slope``."""
        h = np.tanh(x @ self.p[0] + self.p[1])
        back = slope[:, None] * self.p[2] * (1 - h * h)
        grads = [x.T @ back + decay * self.p[0], back.sum(0), h.T @ slope + decay * self.p[2], np.array([slope.sum()])]
        self.t += 1
        for k, g in enumerate(grads):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] = self.p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 16, steps: int = 1500,
          batch: int = 1024, rate: float = 0.005, decay: float = 1e-4, seed: int = 3) -> Network:
    """Non-negative unbiased risk at ``prior``; without one, positives against unlabelled texts."""
    net, random = Network(positive.shape[1], hidden, seed), np.random.default_rng(seed)
    for _ in range(steps):
        p = positive[random.integers(0, len(positive), min(batch, len(positive)))]
        u = unlabelled[random.integers(0, len(unlabelled), min(batch, len(unlabelled)))]
        zp, zu = net.logit(p), net.logit(u)
        x = np.concatenate([p, u])
        if prior is None:
            slope = np.concatenate([-sigmoid(-zp) / len(p), sigmoid(zu) / len(u)])
        else:
            # Loss of a positive: log(1+e^-z); of a negative: log(1+e^z).
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            minus = np.concatenate([-prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)])
            plus = np.concatenate([-prior * sigmoid(-zp) / len(p), np.zeros(len(u))])
            slope = plus + minus if rest >= 0 else -minus
        net.step(x, slope, rate, decay)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.3, errors: float = 1.64) -> float:
    """Share of positives among the unlabelled, by the least ratio of shares above a threshold.

    The ratio bounds the share from above, so ``errors`` standard errors are taken off; the two
    halves are used in turn and averaged.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    bounds = []
    for half in (0, 1):
        net = train(positive[half::2], unlabelled[half::2], None)
        sp, su = np.sort(net.logit(positive[1 - half::2])), np.sort(net.logit(unlabelled[1 - half::2]))
        cuts = np.quantile(sp, np.linspace(0.02, 1 - least, 40))
        p = 1 - np.searchsorted(sp, cuts, side="left") / len(sp)
        u = 1 - np.searchsorted(su, cuts, side="left") / len(su)
        k = np.argmin(u / p)
        u, p = max(u[k], 1 / len(su)), p[k]
        bounds.append(u / p * (1 - errors * np.sqrt((1 - u) / (u * len(su)) + (1 - p) / (p * len(sp)))))
    return float(np.clip(np.mean(bounds), 0.05, 0.98))


@dataclass
class QualityModel:
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    net: Network | None = None
    prior: float = 0.5

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), 0.5)
        return sigmoid(self.net.logit(np.clip((matrix(texts) - self.centre) / self.scale, -8, 8)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        fit_rows: int = FIT_ROWS, prior: float | None = None) -> QualityModel:
    """A model of trusted positives (``label`` above 0) and unlabelled documents, held-out fold left aside."""
    trusted = sample_labels(labels.where(F.col(label) > 0), doc_id, label, fit_rows).select(
        "doc_id", F.lit(True).alias("trusted"))
    open_ids = docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("doc_id"))
    web = open_ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(fit_rows).distinct().select(
        "doc_id", F.lit(False).alias("trusted"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    joined = rows.join(F.broadcast(trusted.union(web)), "doc_id").select("raw", "doc_id", "trusted")
    schema = T.StructType([joined.schema["doc_id"], T.StructField("trusted", T.BooleanType()),
                           T.StructField("x", T.ArrayType(T.DoubleType()))])

    def make():
        def run(batch):
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(list(matrix(as_bytes(batch.column(0)))))], schema.names)
        return run

    # Bounded: twice fit_rows rows of a fixed number of features.
    found = map_rows(joined, make, schema).toPandas().sort_values("doc_id", kind="stable")
    mask = found["trusted"].to_numpy(bool)
    if not mask.any() or mask.all():
        return QualityModel()
    x = np.stack(found["x"])
    centre, scale = x.mean(0), x.std(0) + 1e-6
    x = np.clip((x - centre) / scale, -8, 8)
    if prior is None:
        prior = estimate_prior(x[mask], x[~mask])
    return QualityModel(centre, scale, train(x[mask], x[~mask], prior), prior)


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text",
          cutoff: float = CUTOFF) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def make():
        fitted = shared.value

        def run(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.scores(as_bytes(batch.column(1))))], schema.names)
        return run

    return map_rows(source, make, schema).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
