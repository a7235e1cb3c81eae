"""Quality rules, tokens, decontamination: against brute force and the library."""

import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefloom.llm import bpe, decontaminate, quality_rules, queries

SF = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    again = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text),
            len(lines) - len(set(lines)), len(again))


def test_rules_match_brute_force(odd, documents):
    for docs in (odd, documents):
        texts = sorted((r["doc_id"] or -1, r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"] is not None)
        rows = quality_rules.judge(quality_rules.measures(docs)).collect()
        assert len(rows) == docs.count()
        got = sorted((r["doc_id"] or -1, *[r[c] for c in quality_rules.RESULT[1:6]]) for r in rows)
        nulls = docs.where("text is null").select("doc_id").collect()
        want = sorted([(i, *measured(t)) for i, t in texts] + [(r["doc_id"] or -1, 0, 0, 0, 0, 0) for r in nulls])
        assert got == want
        assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in rows)
        assert not any(r["kept"] for r in rows if r["base_failed"])


def test_failed_rules_are_named(make):
    docs = make([(1, "plain words of the text " + "and more of it " * 2), (2, "a### " * 30), (3, None)])
    named = {r["doc_id"]: r["failed"] for r in quality_rules.failed_rules(quality_rules.measures(docs)).collect()}
    assert named[1] == [] and "symbols per word" in named[2] and "words" in named[3]


def test_tokens_equal_the_library(odd, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for docs in (odd, documents):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"] or -1, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        got = [(r[0] or -1, *r[1:]) for r in bpe.round_trip(docs).collect()]
        assert sorted(got) == sorted(want)


def test_codes_come_back(odd):
    coded = bpe.encode(odd, ids="ids")
    assert coded.columns == [*odd.columns, "ids"]
    back = bpe.decode(coded, ids="ids", text="again").collect()
    assert all(r["again"] == (r["text"] or "") for r in back)
    for taken in ("raw", "Score"):
        with pytest.raises(ValueError, match="rename"):
            bpe.encode(odd, ids=taken)
        with pytest.raises(ValueError, match="rename"):
            bpe.decode(coded, ids="ids", text=taken)


def test_merges_random_unicode():
    import random

    random.seed(4)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    codec = bpe.BpeCodec(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    for _ in range(300):
        text = "".join(chr(random.choice([random.randrange(32, 127), random.randrange(160, 0x500), random.randrange(0x4E00, 0x4F00), 10, 32]))
                       for _ in range(random.randrange(60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and codec.decode(ids) == text


def plain_words(text):
    return PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected_hits(text, items, size=10):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        parts = plain_words(item)
        k = min(size, len(parts))
        for i in range(len(parts) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j:j + k] == parts[i:i + k]:
                    hit.update(range(j, j + k))
                    names.add(str(name))
    return len(words), len(hit), ",".join(sorted(names))


def test_decontamination_matches_brute_force(spark, make):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (10, "short ITEM"),
             (3, None), (4, " .. "), (5, "ünïcode ß token")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make([
        (1, "x ONE two-three four five six seven eight nine ten y eleven"), (2, "a short, item short item"), (3, None), (4, ""),
        (5, "two three four five six seven eight nine ten eleven twelve one"), (6, "shorts item"), (7, "Ünïcode ß token ünïcode ß token"),
        (2, "a short, item short item"), (2, "clean under the same id"), (None, "short item by nobody"), (None, "clean"),
        (None, "one two three four five six seven eight nine ten eleven twelve, and a short item")])
    key = lambda r: (r["doc_id"] or -1, *r[1:])
    want = sorted((r["doc_id"] or -1, *expected_hits(r["text"], items)) for r in docs.collect())
    whole = sorted(map(key, decontaminate.scan(docs, benchmark).collect()))
    for block_bytes in (10_000, 60, 30):
        scanned = decontaminate.scan(docs, benchmark, block_bytes=block_bytes)
        got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in scanned.collect())
        assert got == want and sorted(map(key, scanned.collect())) == whole
        left = decontaminate.clean(docs, benchmark, block_bytes=block_bytes)
        assert left.count() == sum(not w[3] for w in want)
    spans = {r["doc_id"]: r["spans"] for r in decontaminate.scan(docs, benchmark).collect()}
    text = "x ONE two-three four five six seven eight nine ten y eleven"
    assert [text[a:b] for a, b in spans[1]] == ["ONE two-three four five six seven eight nine ten"]
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(w[0] for w in want if not w[2])


def window_owners(items):
    """The items of each window of ten words, or of a whole shorter item."""
    where = {}
    for name, text in items:
        words = plain_words(text)
        k = min(10, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            where.setdefault(tuple(words[i:i + k]), set()).add(str(name))
    return where


def test_registered_decontamination_matches_brute_force(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    where = window_owners(items)
    sizes = {len(w) for w in where}
    got = {r["doc_id"]: r for r in queries.op10_decontamination(spark, SF).collect()}
    for r in documents.collect():
        words, hit, names = plain_words(r["text"]), set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                if found := where.get(tuple(words[i:i + k])):
                    hit.update(range(i, i + k))
                    names |= found
        mine = got.pop(r["doc_id"])
        assert (mine["n_words"], mine["n_hit"], mine["n_items"]) == (len(words), len(hit), len(names))
        assert mine["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    assert not got


def test_digest_of_no_items(make, spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.digest(decontaminate.scan(make([(1, "a b")]), empty)).first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest() and not row["contaminated"]


def test_empty_tables(make, spark):
    none = make([(1, "a")]).where("false")
    benchmark = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert bpe.round_trip(none).count() == 0
    assert decontaminate.scan(none, benchmark).count() == 0
    assert quality_rules.judge(quality_rules.measures(none)).count() == 0
