"""Near-duplicates and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from prefloom.llm import neardup, queries, suffixes, tables
from prefloom.llm.bwt import repeated

SF = "/root/testdata/sf0.001"


def components_of(rows, size, percent=80):
    """Smallest reachable id by comparing all pairs of texts."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        k = min(size, len(words))
        sets[i] = frozenset(tuple(words[j:j + k]) for j in range(len(words) - k + 1)) if words else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(seed, n, base_words=120, most=12):
    random.seed(seed)
    base = [f"w{random.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(random.randrange(most)):
            at = random.randrange(len(words))
            words[at:at + 1] = random.choice([[], ["new%d" % random.randrange(10**6)], [words[at], "more"]])
        out.append(" ".join(words))
    return out


def test_near_duplicates_match_all_pairs(make):
    texts = variants(1, 60) + variants(2, 5) + ["Same words here"] * 3 + ["SAME words\there", "other", "", None, " "]
    rows = list(enumerate(texts, 10))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(make(rows)).collect()}
    want = components_of(rows, 5)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_null_ids_and_repeated_rows_stay_defined(odd):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[4] == 1 and 5 not in ids and ids[None] == 1 and ids[1] == 1


def test_rows_with_one_id_are_judged_by_their_own_texts(make):
    a, b, c = variants(5, 1)[0], variants(6, 1)[0], variants(7, 1)[0]
    docs = make([(1, a), (1, b), (2, b + " tail"), (2, c), (2, c), (3, a + " end"), (4, ""), (4, None), (4, " "), (None, a)])
    rows = Counter((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect())
    assert rows == {(1, 1): 2, (2, 1): 1, (2, 2): 2, (3, 1): 1, (4, 4): 3, (None, None): 1}
    left = Counter((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(docs).collect())
    assert (left[1, a], left[1, b], left[2, c], left[None, a]) == (1, 1, 1, 1) and sum(left.values()) == 6
    clash = docs.withColumnsRenamed({"raw": "text_hash", "row": "kept_id", "n": "kept_hash"})
    assert neardup.drop_near_duplicates(clash).columns == clash.columns and neardup.drop_near_duplicates(clash).count() == 6


def test_registered_queries_match_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op3_minhash(spark, SF).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in components_of(rows, 4).items()}
    assert sorted(tuple(r) for r in queries.op7_suffixes(spark, SF).collect()) == removal(rows)


def test_empty_table_has_no_groups(make):
    none = make([(1, "a")]).where("false")
    assert neardup.near_duplicates(none).count() == 0
    assert suffixes.digests(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in tables.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_joins_beside_facts_lose_nothing(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 99), ("none", 7)], "k string, i int")
    facts = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    assert Counter(r["k"] for r in tables.beside(rows, facts, ["k"], ["i"]).collect()) == {"hot": 50, "cold": 1}


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion_matches_counting(seed):
    random.seed(seed)
    for _ in range(40):
        letters = random.choice([b"ab", b"abcd", bytes(range(256))])
        length = random.choice([1, 2, 3, 7, 20])
        base = bytes(random.choice(letters) for _ in range(120))
        strings = []
        for _ in range(random.randint(1, 7)):
            s = bytearray(base[random.randint(0, 60):random.randint(0, 120)])
            for _ in range(random.randint(0, 2)):
                if s:
                    s[random.randrange(len(s))] = random.choice(letters)
            strings.append(bytes(s))
        count = Counter(s[i:i + length] for s in strings for i in range(len(s) - length + 1))
        for s, again in zip(strings, repeated(strings, length)):
            assert again.tolist() == [i + length <= len(s) and count[s[i:i + length]] > 1 for i in range(len(s))]


def repeated_bytes(texts, length=200):
    """Per text, which bytes a string covers that starts elsewhere too."""
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k:k + length]] > 1:
                gone[k:k + length] = True
        yield bytes(b for b, g in zip(t, gone) if not g), gone


def removal(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, (left, gone) in zip(rows, texts, repeated_bytes(texts, length)):
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("name_bytes", [4_000_000, 400])
def test_removal_matches_counting(make, name_bytes):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefgé") for _ in range(random.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, loop = prose(90), "tick tock " * 80
    rows = [(i, prose(random.randint(5, 60)) + " " + shared[random.randint(0, 40):] + " " + prose(30)) for i in range(12)]
    rows += [(20, rows[0][1]), (21, shared), (22, loop), (23, None), (24, ""), (25, "short"), (26, prose(200)), (27, "z" * 199), (28, "y" * 200), (29, "y" * 201)]
    got = sorted(tuple(r) for r in suffixes.digests(make(rows), name_bytes=name_bytes).collect())
    assert got == removal(rows)


def test_cleaned_texts_keep_columns_and_whole_characters(make):
    passage = "é" * 150
    rows = [(1, "a" + passage + "b"), (2, "c" + passage + "d"), (3, None), (3, "other"), (None, "left alone")]
    kept = suffixes.drop_repeats(make(rows))
    assert kept.columns == make(rows).columns
    odd = make(rows).withColumnsRenamed({"raw": "_i", "row": "_r", "n": "_row", "_h": "_spans"})
    assert suffixes.drop_repeats(odd).columns == odd.columns and suffixes.drop_repeats(odd).count() == len(rows)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(
        {(1, "ab"): 1, (2, "cd"): 1, (3, None): 1, (3, "other"): 1, (None, "left alone"): 1})
