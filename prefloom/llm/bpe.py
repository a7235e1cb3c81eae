"""Byte-level BPE: merges by rank over a linked symbol list, and decoding by concatenation.

The vocabulary file is read on the driver (its size is that of a tokenizer, a few megabytes,
whatever the documents are) and broadcast. Documents are encoded whole, a row at a time inside
Arrow batches; nothing is shuffled.

Edge cases: a null text counts as empty and has no tokens; empty texts have none either;
repeated rows are coded each on their own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.batches import as_bytes, fresh_name, map_rows

CACHED_PIECES = 200_000
CACHED_BYTES = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by its rule.

    Printable bytes stand for themselves; the others take code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeCodec:
    """Encoder and decoder of one vocabulary in the tokenizers library's JSON form."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = data["model"]["vocab"]
        ids = {to_bytes(token): i for token, i in vocab.items()}
        self.bytes_of = {i: token for token, i in ids.items()}
        self.start = [ids[bytes([b])] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = to_bytes(left), to_bytes(right)
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        codec = self

        class Cache(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                raw = piece.encode()
                coded = tuple(codec.merge(raw))
                if len(raw) <= CACHED_BYTES:
                    if len(self) >= CACHED_PIECES:
                        self.clear()
                    self[piece] = coded
                return coded

        self.cache = Cache()

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece.

        Symbols form a doubly linked list. A queue holds possible merges by rank, then place;
        an entry whose symbols have changed since is stale and skipped.
        """
        symbols = [self.start[b] for b in raw]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        merges = self.merges
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                found = merges.get((merged, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, symbols[h], merged, found[1]))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += chain.from_iterable(map(self.cache.__getitem__, self.pieces.findall(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The concatenated vocabulary strings; broken UTF-8 shows as replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _shared_spec(df: DataFrame, path: str | None):
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _refuse(df: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"rename this column first: {name}")


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` as an added array column ``ids``; a taken name is refused."""
    _refuse(docs, ids)
    spec, kinds = _shared_spec(docs, path), T.StructType([*docs.schema.fields, T.StructField(
        ids, T.ArrayType(T.IntegerType(), False), False)])
    place = docs.columns.index(text)

    def make():
        codec = BpeCodec(spec.value)

        def run(batch):
            coded = [codec.encode(t or "") for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(coded, pa.list_(pa.int32()))], [*batch.schema.names, ids])
        return run

    return map_rows(docs, make, kinds)


def decode(coded: DataFrame, ids: str = "token_ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``coded`` with the text of the id array ``ids`` (null: empty) as an added column ``text``; a taken name is refused."""
    _refuse(coded, text)
    spec, kinds = _shared_spec(coded, path), T.StructType([*coded.schema.fields, T.StructField(
        text, T.StringType(), False)])
    place = coded.columns.index(ids)

    def make():
        codec = BpeCodec(spec.value)

        def run(batch):
            texts = [codec.decode(i or []) for i in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])
        return run

    return map_rows(coded, make, kinds)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document, the number of tokens and digests of the ids and of the text decoded from them.

    Same codec as :func:`encode` and :func:`decode`, in one pass, so that ids need not travel.
    """
    spec = _shared_spec(docs, path)
    kind = docs.schema[doc_id].dataType
    name = fresh_name(docs.select(doc_id), "_text")
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make():
        codec = BpeCodec(spec.value)
        written = {i: str(i) for i in codec.bytes_of}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def run(batch):
            rows = []
            for raw in as_bytes(batch.column(1)):
                ids = codec.encode(raw.decode("utf-8", "replace"))
                rows.append((len(ids), sha(",".join(map(written.__getitem__, ids))), sha(codec.decode(ids))))
            counts, coded, decoded = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                schema.names)
        return run

    return map_rows(docs.select(doc_id, F.col(text).cast("binary").alias(name)), make, schema)
