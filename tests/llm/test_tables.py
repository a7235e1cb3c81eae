"""Sharding, URL filters, the pipeline and the registered queries."""

import datetime
import hashlib

import duckdb
import public_tokenizers
import pytest
from test_dedup import components_of, repeated_bytes
from test_texts import plain_words, window_owners
from tokenizers import Tokenizer

import corpus_pipeline
from prefloom.llm import queries, sharding, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DAY = datetime.date


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.date()
    return value


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    answer = con.execute(queries.ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(got.columns)
    theirs = sorted(tuple(map(plain, r)) for r in answer.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == theirs


def test_only_large_buckets_split(make):
    rows = [(i, "x" * (i % 50)) for i in range(400)]
    for step in (2, 5):
        got = sharding.assign(make(rows), limit=700, step=step, keep=["doc_id"]).collect()
        sizes, parents = {}, {}
        for r in got:
            sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
            for k in range(len(r["shard"])):
                parents[r["shard"][:k]] = parents.get(r["shard"][:k], 0) + r["n_bytes"]
        assert len(got) == 400 and all(r["fits"] and r["shard_bytes"] == sizes[r["shard"]] <= 700 for r in got)
        assert all(n > 700 for n in parents.values())
        names = sorted(sizes)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_splitting_limit_equals_sql(spark, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    sql = sharding.ORACLE.replace(str(sharding.SHARD_BYTES), "20000")
    names = ["doc_id", "n_bytes", "shard", "shard_bytes", "shard_rows", "fits"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    got = sorted(tuple(r[c] for c in names) for r in sharding.assign(documents, limit=20_000, keep=["doc_id"]).collect())
    assert got == want and len({r[2] for r in got}) > 10


def test_rows_that_cannot_be_split(odd, make):
    docs = make([(1, "a" * 100), (1, "a" * 100), (2, "b" * 500), (3, "c"), (None, None), (None, None)])
    got = sharding.assign(docs, limit=150, keep=["doc_id"]).collect()
    assert len(got) == 6
    assert all(not r["fits"] and r["shard_rows"] == 2 and len(r["shard"]) == 60 for r in got if r["doc_id"] == 1)
    assert all(not r["fits"] and r["shard_rows"] == 1 for r in got if r["doc_id"] == 2)
    assert all(r["n_bytes"] == 0 and r["fits"] for r in got if r["doc_id"] is None)
    assert sharding.assign(docs.where("false")).count() == 0
    whole = sharding.assign(odd, limit=10**9)
    assert whole.columns == [*odd.columns, *sharding.ADDED] and {r["shard"] for r in whole.collect()} == {""}
    named = odd.withColumnsRenamed({"raw": "_entry", "row": "_b", "n": "prefix"})
    assert sharding.assign(named, limit=1000).columns == [*named.columns, *sharding.ADDED]
    assert sharding.assign(named, limit=1000).count() == odd.count()
    with pytest.raises(ValueError, match="shard"):
        sharding.assign(odd.withColumnRenamed("score", "shard"))


def test_shards_are_written(spark, make, tmp_path):
    docs = make([(i, "x" * 40) for i in range(60)])
    manifest = sharding.write_shards(docs, str(tmp_path / "out"), limit=400).collect()
    assert sum(r["shard_rows"] for r in manifest) == 60 and all(r["shard_bytes"] <= 400 for r in manifest)


def test_url_parts(spark):
    urls = ["HTTP://User@A.B.example.COM.:80/p/q/?x#y", "https://localhost", "no url", None, "http:///x", "http://h/a//b"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    rows = df.select(url_filter.host_of(df.u), url_filter.path_of(df.u), url_filter.domains(url_filter.host_of(df.u)),
                     url_filter.beginnings(url_filter.path_of(df.u))).collect()
    assert rows[0][:] == ("a.b.example.com", "/p/q", ["a.b.example.com", "b.example.com", "example.com"], ["", "/p", "/p/q"])
    assert rows[1][:] == ("localhost", "", ["localhost"], [""])
    assert [r[0] for r in rows[2:5]] == [None, None, None]


def test_entries_hold_from_addition_to_removal(spark):
    d = lambda k: DAY(2024, 1, k)
    entries = spark.createDataFrame([
        ("spam", "Bad.com", None, d(5), True), ("spam", "bad.com", None, d(7), True), ("spam", "bad.com", "/", d(10), False),
        ("spam", "bad.com", None, d(20), True), ("spam", "bad.com", None, d(20), False), ("spam", "bad.com", None, d(2), False),
        ("adult", "x.ok.com", "/a", d(1), True), (None, "bad.com", None, d(1), True), ("spam", None, None, d(1), True),
        ("spam", "bad.com", None, None, True), ("spam", "never.com", None, d(3), False)],
        "list string, host string, path string, day date, added boolean")
    captures = spark.createDataFrame([
        (1, "http://bad.com/x", d(4)), (2, "http://bad.com/x", d(5)), (3, "http://www.bad.com", d(9)), (4, "http://bad.com", d(10)),
        (5, "http://bad.com", d(25)), (6, "http://x.ok.com/a/b", d(3)), (7, "http://x.ok.com/ab", d(3)), (8, "http://ok.com/a", d(3)),
        (9, None, d(6)), (10, "http://bad.com", None), (11, "http://never.com", d(9)), (2, "http://bad.com/x", d(5))],
        "spans int, url string, day date")
    judged = url_filter.judge(captures, entries).collect()
    assert len(judged) == 12
    assert sorted(r["spans"] for r in judged if r["blocked"]) == [2, 2, 3, 5, 6]
    assert [r["lists"] for r in judged if r["spans"] == 6] == [["adult"]]
    assert url_filter.judge(captures, entries.where("false")).where("blocked").count() == 0
    assert url_filter.judge(captures.where("false"), entries).count() == 0
    with pytest.raises(ValueError, match="host"):
        url_filter.judge(captures.withColumnRenamed("spans", "host"), entries)


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "bpe"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "bpe":
            assert docs.schema.names == before.schema.names
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert sizes[-1] == toxicity.score(before, model).where("predicted = 0").count()
        if name == "suffix_dedup":
            assert docs.where("n_chars <> length(text)").count() == 0
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] > sizes[4] == sizes[5]


def test_pipeline_of_no_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_takes_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in left} == {1, 2, 3, 4, 6, 7, 8, 9, 10, None}


def test_pipeline_equals_plain_stages(spark, documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    toxic = {r["doc_id"] for r in queries.op2_toxicity(spark, SF).collect() if r["predicted"] == 1}
    left = [(i, t) for i, t in sorted(rows.items()) if i not in toxic]
    found = components_of(left, 5)
    left = [(i, t) for i, t in left if found[i][1] == i]
    cleaned = repeated_bytes([(t or "").encode() for _, t in left])
    left = [(i, raw.decode("utf-8", "ignore")) for (i, _), (raw, _) in zip(left, cleaned)]
    where = window_owners([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    sizes = {len(w) for w in where}
    clean = lambda words: not any(tuple(words[i:i + k]) in where for k in sizes for i in range(len(words) - k + 1))
    left = [(i, t) for i, t in left if clean(plain_words(t))]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in left:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)
