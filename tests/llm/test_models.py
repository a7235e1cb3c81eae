"""Fitted models: held-out accuracy, edge cases and the numeric parts by themselves."""

import zlib

import numpy as np
import pytest

from prefloom.llm import pseudo_likelihood, quality_model, toxicity
from prefloom.llm.boosting import BoostedTrees, CalibratedTrees, isotonic



def auc(y, score):
    order = np.argsort(score, kind="stable")
    values, at, count = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[at]
    return (rank[y[order] == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF01}/{n}.parquet") for n in ("documents", "labels")]


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.9), (quality_model, "quality", 0.95)])
def test_held_out_rows_are_told_apart(tables, module, label, least):
    docs, labels = tables
    rows = module.score(docs, module.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.CUTOFF) for r in rows)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    y = np.array([truth[r["doc_id"]] for r in held])
    assert auc(y, np.array([r["score"] for r in held])) > least
    assert np.mean(y == np.array([r["predicted"] for r in held])) > 0.9


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_odd_rows_and_missing_labels(spark, odd, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = module.score(odd, module.fit(odd, none)).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0.5 for r in rows)
    some = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, None, 1), (8, 0, 1), (8, 0, 1), (None, 1, 1)], none.schema)
    model = module.fit(odd, some)
    rows = module.score(odd, model).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r["score"]) for r in rows)
    empty = odd.where("false")
    assert module.score(empty, module.fit(empty, some)).count() == 0


def test_toxic_rows_go_and_columns_stay(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    kept = toxicity.drop_toxic(docs, model)
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert bad and kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad


def test_trees_learn_an_interaction_and_are_calibrated():
    random = np.random.default_rng(0)
    x = random.normal(size=(3000, 4))
    y = (((x[:, 0] > 0) ^ (x[:, 1] > 0)) & (random.random(3000) < 0.9)).astype(float)
    assert auc(y, BoostedTrees().fit(x, y).margin(x)) > 0.9
    p = CalibratedTrees().fit(x, y).probability(x)
    assert abs(p.mean() - y.mean()) < 0.05
    xs, ys = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.allclose(np.interp([1, 2, 3, 4], xs, ys), [0, 0.5, 0.5, 1])


def test_prior_is_estimated_from_positives_and_mixture():
    random = np.random.default_rng(1)
    good, bad = random.normal(1.5, 1, (3000, 2)), random.normal(-1.5, 1, (3000, 2))
    mixture = np.concatenate([good[1000:2400], bad[:600]])
    prior = quality_model.estimate_prior(good[:1000], mixture)
    assert 0.6 < prior < 0.75
    net = quality_model.train(good[:1000], mixture, prior)
    assert np.mean(net.logit(good[2400:]) > 0) > 0.9 and np.mean(net.logit(bad[600:]) > 0) < 0.1


SMALL = pseudo_likelihood.Shape(classes=4, buckets=3, hidden=5, side=2)


def small_network():
    random = np.random.default_rng(2)
    vocabulary = pseudo_likelihood.Vocabulary(SMALL, np.array([40, -7, 3]), random.integers(1, 100, SMALL.tokens).astype(float))
    return [w.astype(np.float64) + random.normal(0, 0.3, w.shape) for w in pseudo_likelihood.first_weights(vocabulary)]


def plain_log_probability(weights, texts):
    """Every place of every text by loops, from the definition."""
    total, side = 0.0, SMALL.side
    for text in texts:
        for i, target in enumerate(text):
            layer = weights[1].copy()
            for k, d in enumerate(d for d in range(-side, side + 1) if d):
                layer += weights[0][text[i + d] if 0 <= i + d < len(text) else SMALL.tokens, k]
            layer = np.maximum(layer, 0)
            kind, part = divmod(int(target), SMALL.classes)
            for scores, at in ((layer @ weights[2] + weights[3], kind), (layer @ weights[4][kind] + weights[5][kind], part)):
                total += scores[at] - np.log(sum(np.exp(x) for x in scores))
    return total


def lines(texts):
    return pseudo_likelihood.chunks(np.concatenate(texts), np.array([len(t) for t in texts]), SMALL)


def test_scores_equal_plain_loops(monkeypatch):
    random, weights = np.random.default_rng(4), small_network()
    texts = [random.integers(0, SMALL.tokens, n) for n in (1, 2, 0, 7, 30, 3)]
    want = plain_log_probability(weights, texts)
    for places in (1 << 14, 4):
        monkeypatch.setattr(pseudo_likelihood, "PLACES", places)
        got = sum(pseudo_likelihood.log_probabilities(weights, *c).sum() for c in lines(texts))
        assert got == pytest.approx(want)
    big = [w * 400 for w in weights]
    assert all(np.isfinite(pseudo_likelihood.log_probabilities(big, *c)).all() for c in lines(texts))


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "PLACES", 9)
    random, weights = np.random.default_rng(6), small_network()
    texts = [random.integers(0, SMALL.tokens, n) for n in (12, 1, 9)]
    sums = [np.zeros_like(w) for w in weights]
    for c in lines(texts):
        pseudo_likelihood.add_gradients(weights, *c, sums)
    for w, g in zip(weights, sums):
        for _ in range(12):
            at = tuple(random.integers(0, n) for n in w.shape)
            before, each = w[at], []
            for step in (1e-5, -1e-5):
                w[at] = before + step
                each.append(-plain_log_probability(weights, texts))
            w[at] = before
            assert g[at] == pytest.approx((each[0] - each[1]) / 2e-5, abs=1e-4)


@pytest.mark.parametrize("long", [1, 3, 32])
def test_stretches_of_rows_are_added_up(monkeypatch, long):
    monkeypatch.setattr(pseudo_likelihood, "LONG", long)
    random = np.random.default_rng(8)
    rows, token = random.normal(0, 1, (300, 5)), np.sort(np.repeat(np.arange(40), random.integers(1, 60, 40)))
    order = random.integers(0, 300, len(token))
    want = np.zeros((40, 5))
    np.add.at(want, token, rows[order])
    assert pseudo_likelihood._stretch_sums(rows, order, pseudo_likelihood._runs(token)) == pytest.approx(want)


def test_probabilities_sum_to_one():
    shape = pseudo_likelihood.Shape()
    weights = pseudo_likelihood.first_weights(pseudo_likelihood.Vocabulary(shape, np.array([1]), np.ones(shape.tokens)))
    line = np.full(shape.tokens + 2 * shape.side, 3)
    each = pseudo_likelihood.log_probabilities(weights, line, np.arange(shape.tokens) + shape.side, np.arange(shape.tokens))
    assert abs(np.exp(each.astype(float)).sum() - 1) < 1e-3
    again = pseudo_likelihood.shaped(pseudo_likelihood.flat(weights), shape)
    assert all((a == b).all() for a, b in zip(again, weights))


def test_pseudo_likelihood_beats_frequencies_alike_at_any_number_of_tasks(tables, odd):
    docs, _ = tables
    mean = lambda m: pseudo_likelihood.score(docs, m).selectExpr("sum(log_prob) / sum(n_tokens)").first()[0]
    gains = []
    for n in (1, 16):
        model = pseudo_likelihood.fit(docs.repartition(n))
        start = pseudo_likelihood.WindowModel(model.vocabulary, pseudo_likelihood.first_weights(model.vocabulary))
        gains.append(mean(model) - mean(start))
    assert gains[0] > 0.4 and gains[1] == pytest.approx(gains[0], rel=0.02)
    counts = docs.selectExpr("size(split(trim(text), '[ \\t-\\r]+')) n").selectExpr("sum(n)").first()[0]
    assert model.vocabulary.counts.sum() == pytest.approx(counts, rel=0.01) and model.vocabulary.counts.min() >= 0
    small = pseudo_likelihood.fit(docs, shape=pseudo_likelihood.Shape(classes=8, buckets=16, hidden=4, side=1), parts=3)
    assert small.weights[0].shape == (65, 2, 4) and len(small.vocabulary.words) == 48
    rows = {r["doc_id"]: r for r in pseudo_likelihood.score(odd, model).collect()}
    assert rows[1]["n_tokens"] == 0 and rows[1]["log_prob"] == 0 and rows[1]["mean_log_prob"] is None
    assert rows[7]["n_tokens"] == 80_000 and rows[7]["log_prob"] < 0
    both = pseudo_likelihood.fit_and_score(odd).collect()
    assert len(both) == odd.count() and sorted(r["n_tokens"] for r in both) == sorted(
        r["n_tokens"] for r in pseudo_likelihood.score(odd, model).collect())
    empty = odd.where("false")
    assert pseudo_likelihood.score(empty, pseudo_likelihood.fit(empty)).count() == 0 == pseudo_likelihood.fit_and_score(empty).count()
