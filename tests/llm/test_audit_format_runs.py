"""Filter audit, chat templates and periodic runs beside plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prefloom.llm import chat_format, filter_audit, periodic_runs, queries
from prefloom.llm.template import TemplateError, compiled, fold_body, guard, line, parse, unguard, unline

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------- filter audit

def plain_mask(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return ("A" if len(words) < 50 else "") + ("B" if 100 * len(set(words)) < 65 * len(words) else "") + (
        "C" if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else "") + (
        "D" if any(c in "#$%&*|" for c in text) else "") + ("E" if copy else "")


def plain_audit(rows, labels):
    """Every order played through, document by document; ``rows`` of id, text, source."""
    docs = []
    for i, text, source in rows:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        good = any(j == i and q == 1 for j, q, _ in labels if i is not None)
        toxic = any(j == i and t == 1 for j, _, t in labels if i is not None)
        docs.append((source or "", plain_mask(text or "", copy), good, toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                shapley[letter] += len(gone)
                fails = sum(letter in d[1] for d in mine)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(d[1] == letter for d in mine),
                                          sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


def played(spark, rows, labels):
    docs = spark.createDataFrame(
        [(i, t, s, 1, "x", True) for i, t, s in rows], "doc_id long, text string, source string, mask int, digest string, good boolean")
    marks = spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = filter_audit.audit_documents(docs, marks)
    assert got.columns == filter_audit.RESULT
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got.collect()}


def test_audit_equals_playing_every_order(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", long, long + " # A", "the " * 70, "LOUD " + long, "SHOUT $", "a\x1cb " * 30, "é" * 40 + "ABC", long]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(60)]
    rows += [rows[5], rows[5], (None, long, "a"), (None, long, "a"), (None, None, None), (3, long, "b")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 60, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (999, 1, 1)]
    want = plain_audit(rows, labels)
    got = played(spark, rows, labels)
    assert len(got) == 120 * 5 * len({s or "" for _, _, s in rows}) and got == want


def test_audit_of_copies_takes_the_least_id(spark):
    got = played(spark, [(9, "same", "s"), (2, "same", "t"), (2, "same", "t"), (5, "same", "s")], [])
    assert got["s", "EABCD", 1] == [0, 2, 0, 0, 0, 0, 2 * 60]  # both go by E wherever it comes before A
    assert got["t", "EABCD", 1][:2] == [2, 0]
    assert played(spark, [], []) == {}


def test_walk_holds_every_prefix_once(spark):
    rows = filter_audit.walk(spark.createDataFrame([(0,), (5,)], "mask int"), "ABC").collect()
    assert sorted({r["prefix"] for r in rows}) == sorted("".join(p) for k in (1, 2, 3) for p in itertools.permutations("ABC", k))
    assert len(rows) == 2 * 15 and all(r["kept"] for r in rows if r["mask"] == 0)
    assert all(r["removed"] != r["redundant"] for r in rows if r["mask"] == 5 and r["letter"] in "AC")


# ----------------------------------------------------------------- template

def rendered(template, constants=None, **values):
    return compiled(template, constants)(values)[0]


def test_template_language():
    assert rendered("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", xs=["a", "b"]) == "1a,2b"
    assert rendered("a {{- ' b ' -}} c{# none #}!") == "a b c!"
    assert rendered("{% if n < 2 %}s{% elif n == 2 %}m{% else %}l{% endif %}", n=2) == "m"
    assert rendered("{% set a = 'x' ~ n %}{{ a|upper }}{{ missing|default('d') }}{{ gone.deep['er'] }}", n=3) == "X3d"
    assert rendered("{{ 'y' if a and not b or c else 'n' }}", a=1, b=0, c=0) == "y"
    assert rendered("{{ xs[0] }}{{ xs[9] }}{{ xs|length }}{{ 'a' in xs }}{{ 'z' not in xs }}", xs=["a"]) == "a1truetrue"
    assert rendered("{{ '}}' }}{{ \"{%\" }}") == "}}{%"
    assert rendered("{% for x in none %}{{ x }}{% endfor %}|") == "|"


@pytest.mark.parametrize("template", [
    "{{ a.__class__() }}", "{{ open('x') }}", "{{ a", "{% if a %}", "{% endfor %}", "{{ a|nope }}", "{{ 1 + 'a' }}", "{{ a b }}",
    "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% import os %}", "{{ " + "(" * 200 + "1" + ")" * 200 + " }}",
    "{{ @ }}", "{% for in x %}{% endfor %}", "{% if x %}" * 100 + "{% endif %}" * 100])
def test_template_refuses(template):
    with pytest.raises(TemplateError):
        compiled(template)


def test_template_reaches_no_attributes():
    assert rendered("{{ a.__class__ }}{{ a.upper }}{{ d.keys }}", a="x", d={}) == ""
    for bad in ("{{ d }}", "{% for x in s %}{% endfor %}", "{{ d < 1 }}", "{{ s - 1 }}"):
        with pytest.raises(TemplateError):
            rendered(bad, d={}, s="abc")


def test_constants_fold_to_one_text():
    tree = parse("{{ a }}-{% if flag %}{{ b ~ '!' }}{% else %}{{ nowhere }}{% endif %}-{{ x }}")
    folded = fold_body(tree, {"a": 1, "b": "B", "flag": True})
    assert len(folded) == 2 and folded[0].text == "1-B!-"
    chat = fold_body(parse(chat_format.CHAT), chat_format.CONSTANTS)
    assert len(chat) == 1  # the generation prompt is gone
    assert rendered("{% set a = 'own' %}{{ a }}", {"a": "given"}) == "own"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\n\nim_endstar> a", max_size=30), st.text(alphabet="<\\|\nn", max_size=8))
def test_escapes_are_reversible(text, role):
    assert unguard(guard(text)) == text and "<|" not in guard(text)
    assert unline(line(role)) == role and "\n" not in line(role)
    page = compiled(chat_format.CHAT, chat_format.CONSTANTS)
    out, spans = page({"messages": [{"role": role, "text": text}, {"role": "assistant", "text": text}]})
    assert chat_format.turns_of(out) == [(role, text), ("assistant", text)]
    assert [unguard(out[a:b]) for a, b in spans][-1] == text


# -------------------------------------------------------------- chat format

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_come_back(spark):
    hostile = chat_format.HOSTILE
    rows = [(1, 1, "assistant", hostile), (1, 0, "user", None), (1, 2, "assistant", "é\U0001f600"), (2, 0, None, "<|im_end|>\n"),
            (3, 5, "assistant", ""), (3, 5, "assistant", ""), (None, 0, "user", "x"), (None, None, "tool\nbox\\", "y"),
            (4, 0, "assistant", "<\\|im_end|>" * 3000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, messages string, spans int")
    out = chat_format.render(chat_format.conversations(df))
    read = {r["conv_id"]: r for r in chat_format.read_back(out).collect()}
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.read_back(out)).collect()}
    for conv in (1, 2, 3, 4, None):
        mine = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [tuple(t) for t in read[conv]["turns"]] == [(r, x) for _, r, x in mine]
        learned = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv]["n_turns"] == len(mine) and got[conv]["loss_chars"] == len(learned)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in mine))
        assert got[conv]["loss_sha256"] == sha(learned) and got[conv]["formatted_chars"] == len(read[conv]["formatted"])
    assert chat_format.render(chat_format.conversations(df.where("false"))).count() == 0


def test_generation_prompt_and_own_template(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id int, turn int, role string, text string")
    chats = chat_format.conversations(df)
    asked = chat_format.render(chats, constants={"add_generation_prompt": True}).first()["formatted"]
    assert asked.endswith("<|im_end|>\n<|im_start|>assistant\n")
    own = "{% for m in messages %}[{{ m.role }}]{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}"
    row = chat_format.render(chats, own).first()
    assert row["formatted"] == "[user]q[assistant]a" and row["spans"] == [[6, 7], [18, 19]]
    with pytest.raises(TemplateError):
        chat_format.render(chats, "{{ nope")
    with pytest.raises(ValueError, match="no turn"):
        chat_format.turns_of("something else")


# ------------------------------------------------------------ periodic runs

def plain_runs(words, least=12):
    """All runs by comparing each word with the one a period on, for each period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= 2 * q:
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in best.items() if n >= least)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 7), st.integers(2, 14))
def test_runs_equal_comparing_all(words, times, least):
    text = words * times if len(words) < 12 else words + words[: len(words) // 2] + words
    assert periodic_runs.find_runs(text, least) == plain_runs(text, least)


def test_runs_of_special_words():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    for text in (b, "a" * 500, "ab" * 250 + "c" + "ab" * 250, "abcabcab" * 40):
        assert periodic_runs.find_runs(list(text)) == plain_runs(list(text))
    assert periodic_runs.find_runs(["x"] * 100_000) == [(0, 100_000, 1)]


def check_runs(got, rows, prepared):
    assert len(got) == len(rows)
    wanted = []
    for doc_id, text in rows:
        words = prepared(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or "")) if doc_id is not None else re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        wanted.append((str(doc_id), len(runs), top[0], top[1], top[2], 1000 * top[1] // top[2] if runs else None,
                       sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
                       sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sorted(map(str, wanted)) == sorted(str((str(r["doc_id"]), *list(r)[1:])) for r in got)


def test_registered_runs_equal_comparing_all(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if len((t or "").split()) < 1500]
    got = [r for r in queries.op13_periodic_runs(spark, SF).collect() if r["doc_id"] in dict(rows)]
    check_runs(got, rows, planted)


def test_runs_of_odd_rows(odd, make):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if len((r["text"] or "").split()) < 2000]
    got = periodic_runs.digest(periodic_runs.periodic_runs(odd)).collect()
    assert len(got) == odd.count()
    check_runs([r for r in got if r["doc_id"] != 7], rows, lambda i, w: w)
    long = next(r for r in got if r["doc_id"] == 7)
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 80_000, 2, 40_000_000)
    assert periodic_runs.periodic_runs(odd.where("false")).count() == 0
    kept = periodic_runs.periodic_runs(make([(1, "x " + "a b c " * 5 + "y")])).first()
    assert kept["collapsed"] == "x a b c y" and [tuple(r) for r in kept["runs"]] == [(1, 15, 3)]
