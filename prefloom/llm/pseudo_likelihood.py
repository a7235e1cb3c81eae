"""Masked pseudo-likelihood: a window network predicts every token from both of its sides.

Tokens are the most frequent words of the corpus, the others fall into hash buckets. For each place
the words ``side`` to the left and right, by position, add up to a hidden layer, and a softmax
in two steps (class of tokens, token in class) gives the probability of what stands there. A
document's score is the sum of these conditional log probabilities over all of its tokens.

1. Every text is split once. A task numbers the words of the documents it meets and stores blocks:
   the block's words with their counts, and its texts as those numbers. Later passes turn numbers into
   tokens by one look-up per different word of a block.
2. Word counts over all blocks give the vocabulary; its size, ``classes`` squared, and the number of
   ``buckets`` for the other words are parameters (:class:`Shape`).
3. Training starts from the log frequencies and reads every place of the corpus once. Documents are
   dealt by a hash over ``parts``; for each part in turn the tasks sum the gradients of all of its
   places at common weights, the sums are added up slice by slice, and one Adam step follows. What is
   learned depends on the documents alone, not on how many tasks share them, up to rounding.
4. Scoring reads the blocks again and gives a row per document.

What is gathered (counts, gradients of every task) grows with the corpus; only the vocabulary and
the summed gradient, both of a size that the shape fixes, reach the driver.

Edge cases: null and empty texts have no tokens, a log probability of 0 and a null mean; an empty
corpus gives an empty table; repeated rows are scored each on their own; ids may be null or
repeat; columns beyond the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.batches import as_bytes, small_batches
from prefloom.llm.tables import stored
from prefloom.llm.words import split_words
from prefloom.session import scratch_path

PARTS = 16
RATE = 0.06
BLOCK_TOKENS = 1 << 18
PLACES = 1 << 14  # places whose layers are held at a time
ROWS = 1 << 11  # places whose softmax is worked out at a time
LONG = 32  # rows of a stretch that is added up by itself
SLICE = 8192
LANES = 16


@dataclass(frozen=True)
class Shape:
    """Sizes of a network: ``classes`` squared tokens, the last ``buckets`` of which stand for rare words."""

    classes: int = 64
    buckets: int = 512
    hidden: int = 32
    side: int = 2

    @property
    def tokens(self) -> int:
        return self.classes * self.classes

    @property
    def known(self) -> int:
        return self.tokens - self.buckets

    @property
    def arrays(self) -> list[tuple[int, ...]]:
        c, h = self.classes, self.hidden
        return [(self.tokens + 1, 2 * self.side, h), (h,), (h, c), (c,), (c, h, c), (c, c)]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.arrays)


# ------------------------------------------------------------------- blocks

class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class _Block:
    numbers: _Numbers = field(default_factory=_Numbers)
    texts: list[np.ndarray] = field(default_factory=list)
    names: list = field(default_factory=list)
    tokens: int = 0

    def add(self, name, raw: bytes) -> None:
        words = split_words(raw)
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.names.append(name)
        self.tokens += len(words)


def text_blocks(docs: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """The texts as stored blocks ``part, words, counts, numbers, sizes, names``, split once."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    source = source.withColumn("part", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(parts)).cast("int"))
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("numbers", T.BinaryType()),
        T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("names", T.ArrayType(source.schema["doc_id"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = {}, None

        def flushed(part: int, block: _Block) -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, block.numbers), np.uint64, len(block.numbers)).view(np.int64)
            numbers = np.concatenate(block.texts)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([words], pa.list_(pa.int64())),
                pa.array([np.bincount(numbers, minlength=len(words))], pa.list_(pa.int64())), pa.array([numbers.tobytes()]),
                pa.array([[len(t) for t in block.texts]], pa.list_(pa.int32())), pa.array([block.names], pa.list_(kind))], schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, raw, part in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                block = held.setdefault(part, _Block())
                block.add(name, raw)
                if block.tokens >= BLOCK_TOKENS:
                    yield flushed(part, held.pop(part))
        for part, block in held.items():
            yield flushed(part, block)

    path = scratch_path(docs.sparkSession, "text-blocks")
    small_batches(source).mapInArrow(run, schema).write.partitionBy("part").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


@dataclass
class Vocabulary:
    """Hashes of the known words, most frequent first, and how often each token occurs."""

    shape: Shape
    words: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]

    def bucket(self, words: np.ndarray) -> np.ndarray:
        return self.shape.known + words % self.shape.buckets

    def tokens(self, words: np.ndarray) -> np.ndarray:
        """The token of each word, given by hash."""
        bucket = self.bucket(words)
        if not len(self.words):
            return bucket
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.words) - 1)
        return np.where(self.sorted[at] == words, self.order[at], bucket)


def learn_vocabulary(blocks: DataFrame, shape: Shape) -> Vocabulary:
    """The most frequent words over all documents."""
    pairs = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("p")).select("p.words", "p.counts")
    counts = stored(pairs.groupBy(F.col("words").alias("w")).agg(F.sum("counts").alias("n")), "word-counts")
    top = counts.orderBy(F.desc("n"), "w").limit(shape.known).collect()
    known = Vocabulary(shape, np.array([r["w"] for r in top], np.int64), np.zeros(shape.tokens))
    known.counts[:len(top)] = [r["n"] for r in top]
    total = counts.groupBy(F.pmod("w", F.lit(shape.buckets)).alias("b")).agg(F.sum("n").alias("n"))
    for bucket, n in total.collect():
        known.counts[shape.known + bucket] = n
    np.subtract.at(known.counts, known.bucket(known.words), known.counts[:len(top)])
    return known


# ------------------------------------------------------------------ network

def first_weights(vocabulary: Vocabulary) -> list[np.ndarray]:
    """Small random layers, and biases at which the network gives the tokens' frequencies."""
    random, c = np.random.default_rng(5), vocabulary.shape.classes
    weights = [random.normal(0, 0.1, s).astype(np.float32) for s in vocabulary.shape.arrays]
    weights[1][:] = 0
    share = (vocabulary.counts + 0.5).reshape(c, c)
    weights[3] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    weights[5] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return weights


def flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def shaped(vector: np.ndarray, shape: Shape, kind=np.float32) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in shape.arrays])
    return [p.reshape(s).astype(kind) for p, s in zip(np.split(vector, ends[:-1]), shape.arrays)]


def laid_out(texts: np.ndarray, sizes: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Several texts in a row with the extra token beyond each end, and the places of their tokens."""
    side = shape.side
    at = np.arange(len(texts)) + np.repeat(np.arange(1, len(sizes) + 1) * side, sizes)
    padded = np.full(len(texts) + (len(sizes) + 1) * side, shape.tokens, np.int64)
    padded[at] = texts
    return padded, at


def chunks(texts: np.ndarray, sizes: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``line, at, target``: stretches of tokens, the places in them to predict, and what stands there."""
    padded, at = laid_out(texts, sizes, shape)
    for i in range(0, len(texts), PLACES):
        part = at[i:i + PLACES]
        low = part[0] - shape.side
        yield padded[low:part[-1] + shape.side + 1], part - low, texts[i:i + PLACES]


def _shifts(count: int) -> list[int]:
    return [d for d in range(-(count // 2), count // 2 + 1) if d]


def _joined(weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both softmax layers with the biases as a last row, for hidden layers that end in 1."""
    return np.vstack([weights[2], weights[3]]), np.concatenate([weights[4], weights[5][:, None]], axis=1)


def hidden(weights: list[np.ndarray], line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hidden layer, and a 1, of places that have ``side`` tokens of ``line`` on either side."""
    width, size = weights[0].shape[1:]
    rows = weights[0].reshape(-1, size)
    layer = np.ones((len(at), size + 1), rows.dtype)
    total, one = np.empty((2, min(ROWS, len(at)), size), rows.dtype)
    for own in _pieces(0, len(at)):
        place = at[own]
        total, one = total[:len(place)], one[:len(place)]
        for k, d in enumerate(_shifts(width)):
            # Clipping changes no token; without it, take() would write to a buffer of its own first.
            np.take(rows, line[place + d] * width + k, axis=0, out=one if k else total, mode="clip")
            total += one if k else weights[1]
        np.maximum(total, 0, out=layer[own, :-1])
    return layer


def _exponents(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | int]:
    """The exponentials of ``z``, less a row's highest first if need be; their sums by row and what was taken off."""
    low, one = 0, np.ones(z.shape[1], z.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = e @ one
    # Sums of a fair size: no row's highest value is far from 0, and what others lose below it counts for nothing.
    if z.size and not 1e-26 < total.min() <= total.max() < 1e26:
        low = z.max(axis=1)
        e = np.exp(z - low[:, None])
        total = e @ one
    return e, total, low


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _pieces(start: int, end: int) -> Iterator[slice]:
    """Rows from ``start`` to ``end``, ROWS at a time, so that a layer's arrays stay in a core's cache."""
    for i in range(start, end, ROWS):
        yield slice(i, min(end, i + ROWS))


def _by_class(target: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the targets by class, and each class found with its pieces in that order."""
    kind = target // classes
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    edges = np.searchsorted(kind[order], np.arange(classes + 1))
    found = np.flatnonzero(np.diff(edges)).tolist()
    return order, [(c, own) for c in found for own in _pieces(edges[c], edges[c + 1])]


def log_probabilities(weights: list[np.ndarray], line: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of each target given what is around its place."""
    outer, inners = _joined(weights)
    order, pieces = _by_class(target, len(inners))
    kind, part = np.divmod(target[order], len(inners))
    h = hidden(weights, line, at[order])
    found, row = np.empty(len(order), h.dtype), np.arange(ROWS)

    def log_share(z: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        _, total, low = _exponents(z)
        return z[row[:len(z)], wanted] - low - np.log(total)

    for own in _pieces(0, len(order)):
        found[own] = log_share(h[own] @ outer, kind[own])
    for c, own in pieces:
        found[own] += log_share(h[own] @ inners[c], part[own])
    out = np.empty_like(found)
    out[order] = found
    return out


def _slopes(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The softmax of the rows of ``z`` less 1 at the target."""
    e, total, _ = _exponents(z)
    e *= (1 / total)[:, None]
    e[np.arange(len(z)), target] -= 1
    return e


def _stretch_sums(rows: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``rows[order]`` over the stretches that begin at ``starts``.

    Long stretches are added up one by one. Of the others the first rows are taken, then the second ones
    are added, and so on, for all stretches that have them at a time: those are the first ones by length.
    """
    sizes = np.diff(np.append(starts, len(order)))
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    longer = np.searchsorted(-sizes, -np.arange(LONG + 1))  # how many have more than 0, 1, 2 ... rows
    sums, many = rows[order[starts]], longer[-1]
    for i in range(many):
        rest = rows[order[starts[i] + 1:starts[i] + sizes[i]]]
        sums[i] += np.ones(len(rest), rows.dtype) @ rest
    for k in range(1, LONG):
        if longer[k] > many:
            sums[many:longer[k]] += rows[order[starts[many:longer[k]] + k]]
    out = np.empty_like(sums)
    out[by_size] = sums
    return out


def add_gradients(weights: list[np.ndarray], line: np.ndarray, at: np.ndarray, target: np.ndarray, sums: list[np.ndarray]) -> None:
    """Add to ``sums`` the gradient of the summed negative log probability of the targets."""
    outer, inners = _joined(weights)
    order, pieces = _by_class(target, len(inners))
    at, (kind, part) = at[order], np.divmod(target[order], len(inners))
    h = hidden(weights, line, at)
    back = np.empty_like(h)
    for own in _pieces(0, len(at)):
        slope = _slopes(h[own] @ outer, kind[own])
        np.matmul(slope, outer.T, out=back[own])
        given = h[own].T @ slope
        sums[2] += given[:-1]
        sums[3] += given[-1]
    for c, own in pieces:
        slope = _slopes(h[own] @ inners[c], part[own])
        back[own] += slope @ inners[c].T
        given = h[own].T @ slope
        sums[4][c] += given[:-1]
        sums[5][c] += given[-1]
    back = back[:, :-1] * (h[:, :-1] > 0)
    sums[1] += np.ones(len(back), back.dtype) @ back
    # What a token of the line gets from the places that it is beside, summed by token. The rows around
    # a place lie in a row, so a window over them is a view; the place's own row is left out at the end.
    width, size = weights[0].shape[1], back.shape[1]
    side, m = width // 2, len(line)
    spread = np.zeros((m + 4 * side, size), back.dtype)
    spread[at + side] = back
    windows = np.lib.stride_tricks.as_strided(
        spread, (m + 2 * side, (width + 1) * size), (size * spread.itemsize, spread.itemsize), writeable=False)
    by_token = np.argsort(line.astype(np.uint16) if len(weights[0]) < 1 << 16 else line, kind="stable")
    token = line[by_token]
    starts = _runs(token)
    summed = _stretch_sums(windows, by_token, starts).reshape(len(starts), width + 1, size)
    sums[0][token[starts]] += summed[:, [side - d for d in _shifts(width)]]


class Adam:
    """Steps along summed gradients, each weight by its own running size."""

    def __init__(self, size: int, rate: float):
        self.mean, self.square = np.zeros(size), np.zeros(size)
        self.rate, self.steps = rate, 0

    def step(self, vector: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.mean += 0.3 * (gradient - self.mean)
        self.square += 0.05 * (gradient * gradient - self.square)
        mean = self.mean / (1 - 0.7 ** self.steps)
        square = self.square / (1 - 0.95 ** self.steps)
        return vector - self.rate * mean / (np.sqrt(square) + 1e-8)


# --------------------------------------------------------- passes over blocks

def _texts(batch: pa.RecordBatch, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of each block's texts in a row, and the texts' sizes."""
    for words, numbers, sizes in zip(batch.column("words"), batch.column("numbers").to_pylist(), batch.column("sizes")):
        tokens = vocabulary.tokens(words.values.to_numpy(zero_copy_only=False).astype(np.int64))
        yield tokens[np.frombuffer(numbers, np.uint32)], sizes.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors ``v`` added up by ``keys`` and ``slice``; a task streams its rows and holds sums of slices only."""
    schema = "lane int, slice int, n double, v array<float>"

    def run(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            for lane, piece, n, v in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                held = sums.setdefault((lane, piece), [0.0, 0.0])
                held[0] += n
                held[1] = held[1] + v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        for (lane, piece), (n, v) in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([lane], pa.int32()), pa.array([piece], pa.int32()), pa.array([n]),
                pa.array([v.astype(np.float32)], pa.list_(pa.float32()))], ["lane", "slice", "n", "v"])

    return parts.repartition(*keys).mapInArrow(run, schema)


def part_gradient(blocks: DataFrame, part: int, vocabulary: Vocabulary, weights: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Gradient over all places of one part of the corpus, and their number."""
    shape = vocabulary.shape
    shared = blocks.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(batches):
        vocab, at_weights = shared.value
        sums, places, lane = [np.zeros(s, np.float32) for s in shape.arrays], 0, 0
        for batch in batches:
            for tokens, sizes in _texts(batch, vocab):
                for line, at, target in chunks(tokens, sizes, shape):
                    add_gradients(at_weights, line, at, target, sums)
                places += len(tokens)
                lane = places % LANES
        vector = flat(sums)
        for i in range(0, shape.size if places else 0, SLICE):
            yield pa.RecordBatch.from_arrays([
                pa.array([lane], pa.int32()), pa.array([i // SLICE], pa.int32()), pa.array([float(places)]),
                pa.array([vector[i:i + SLICE]], pa.list_(pa.float32()))], ["lane", "slice", "n", "v"])

    chosen = blocks.where(F.col("part") == part).select("words", "numbers", "sizes")
    sums = chosen.mapInArrow(run, "lane int, slice int, n double, v array<float>")
    by_lane = _summed(sums, ["lane", "slice"]).withColumn("lane", F.lit(0))
    found = sorted(_summed(by_lane, ["slice"]).collect(), key=lambda r: r["slice"])
    shared.unpersist()
    if not found:
        return np.zeros(shape.size), 0.0
    return np.concatenate([np.array(r["v"], np.float64) for r in found]), found[0]["n"]


@dataclass
class WindowModel:
    vocabulary: Vocabulary
    weights: list[np.ndarray]


def fit_blocks(blocks: DataFrame, shape: Shape = Shape(), parts: int = PARTS, rate: float = RATE) -> WindowModel:
    """A window network over all stored texts."""
    vocabulary = learn_vocabulary(blocks, shape)
    vector, adam = flat(first_weights(vocabulary)).astype(np.float64), Adam(shape.size, rate)
    for part in range(parts):
        gradient, places = part_gradient(blocks, part, vocabulary, shaped(vector, shape))
        if places:
            vector = adam.step(vector, gradient / places)
    return WindowModel(vocabulary, shaped(vector, shape))


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shape: Shape = Shape(), parts: int = PARTS,
        rate: float = RATE) -> WindowModel:
    """A window network over all documents."""
    return fit_blocks(text_blocks(docs, doc_id, text, parts), shape, parts, rate)


def score_blocks(blocks: DataFrame, model: WindowModel) -> DataFrame:
    """Per document of stored texts ``doc_id, n_tokens, log_prob, mean_log_prob``."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([
        T.StructField("doc_id", blocks.schema["names"].dataType.elementType), T.StructField("n_tokens", T.LongType()),
        T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())])

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for names, (tokens, sizes) in zip(batch.column("names"), _texts(batch, fitted.vocabulary)):
                each = np.concatenate([np.zeros(0), *(
                    log_probabilities(fitted.weights, *c) for c in chunks(tokens, sizes, fitted.vocabulary.shape))])
                total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes)).astype(float)
                mean = np.divide(total, sizes, out=np.full(len(sizes), np.nan), where=sizes > 0)
                yield pa.RecordBatch.from_arrays([
                    names.values, pa.array(sizes), pa.array(total), pa.array(mean, mask=sizes == 0)], schema.names)

    return blocks.select("words", "numbers", "sizes", "names").mapInArrow(run, schema)


def score(docs: DataFrame, model: WindowModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id, n_tokens, log_prob, mean_log_prob``."""
    return score_blocks(text_blocks(docs, doc_id, text, 1), model)


def fit_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shape: Shape = Shape(), parts: int = PARTS,
                  rate: float = RATE) -> DataFrame:
    """Every document under a network of all documents; texts are split once for both."""
    blocks = text_blocks(docs, doc_id, text, parts)
    return score_blocks(blocks, fit_blocks(blocks, shape, parts, rate))
