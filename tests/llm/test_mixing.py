import random

import numpy as np
import pytest

from sampleflow.llm.mixing import Fit, fit, mixed, rates, regression, softmax, train

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=600):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        kind = r.choice([0, 0, 0, 1, 2])
        words = [r.choice("lorem ipsum dolor amet elit sed".split()) for _ in range(r.randrange(5, 60))]
        if kind == 1:
            words = [w + "##" for w in words]
        if kind == 2:
            words[::4] = ["grumble"] * len(words[::4])
        docs.append((i, " ".join(words), "xx", "s", 1))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    rows = docs + [(9000, None, None, None, None), (9001, "", None, None, None), (None, docs[0][1], None, None, None), docs[0]]
    return spark.createDataFrame([(*d, 1, 2) for d in rows], SCHEMA + ", words int, rate int"), spark.createDataFrame(labels[:400] + [(None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int"), docs, labels


def test_totals_meet_the_targets(tables):
    docs, known, rows, labels = tables
    model = train(docs, known)
    assert model.domains == ["quality 0, toxic 0", "quality 1, toxic 0", "quality 1, toxic 1"]
    targets = {"quality 0, toxic 0": 0.02, "quality 1, toxic 0": 0.9, "quality 1, toxic 1": 0.08, "unknown": 3.0}
    found = fit(docs, model, targets)
    assert np.abs(found.totals - found.targets).max() <= 1e-4
    out = {x.doc_id: x for x in rates(docs, found).collect()}
    assert len(out) == len(rows) + 3
    words = sum(len((t or "").split()) for t in [*(d[1] for d in rows), rows[0][1], rows[0][1]])
    everything = rates(docs, found).collect()
    for k in range(3):
        assert sum(x.rate * x.words * x.posterior[k] for x in everything) / words == pytest.approx(found.targets[k], abs=2e-4)
    assert all(x.rate >= 0 and abs(sum(x.posterior) - 1) < 1e-9 and x.copies in (int(x.rate), int(x.rate) + 1) for x in everything)
    kinds = [0 if not q else 2 if t else 1 for _, q, t in labels]
    assert np.mean([np.argmax(out[i].posterior) == kinds[i] for i in range(400, 600)]) > 0.97
    assert out[9000].rate == out[9001].rate == 1 and out[9000].words == 0
    assert out[None].rate == out[0].rate
    more = fit(docs, model, targets, keep_all=True)
    assert np.allclose(more.totals / more.totals.sum(), found.targets, atol=2e-4) and more.totals.sum() > 1
    assert all(x.rate > 0.999 for x in rates(docs, more).collect() if max(x.posterior) > 0.999)
    taken = mixed(docs, found)
    assert taken.columns == docs.columns and taken.count() == sum(x.copies for x in everything)


def test_steps_are_those_of_brute_force():
    rng = np.random.default_rng(0)
    words, p = rng.integers(1, 50, 200).astype(float), rng.dirichlet([0.3] * 3, 200)
    found = Fit(None, words.sum(), [], np.zeros(3), np.zeros(3))
    a, r = (p * (words / words.sum())[:, None]).T, np.ones(200)
    for _ in range(5):
        g = np.linalg.inv(a @ p) @ (a @ r - np.array([0.7, 0.25, 0.05]))
        found.steps.append(g)
        r = np.maximum(0, r - p @ g)
    assert np.allclose(found.rates(words, p), r)


def test_regression_recovers_odds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20000, 2))
    w = np.array([[1.0, -1.0, 0.5], [0.0, 2.0, -1.0]])
    y = (rng.random(20000)[:, None] > softmax(x, w).cumsum(axis=1)).sum(axis=1)
    assert np.abs(regression(x, y, 3) - w).max() < 0.15


def test_defined_cases(spark, tables):
    docs, known, rows, _ = tables
    none = fit(docs, train(docs, known.limit(0)), {"a": 1.0})
    assert mixed(docs, none).count() == docs.count()
    empty = docs.limit(0)
    model = train(docs, known)
    assert mixed(empty, fit(empty, model, {"quality 1, toxic 0": 1.0})).collect() == []
    one = known.where("quality = 1 and toxic = 0")
    assert mixed(docs, fit(docs, train(docs, one), {"quality 1, toxic 0": 1.0})).count() == docs.count()
    for bad in ({}, {"quality 1, toxic 0": -1.0}, {"x": 1.0}):
        with pytest.raises(ValueError):
            fit(docs, model, bad)
    long = spark.createDataFrame([(1, "grumble " * 300_000, None, None, None)], SCHEMA)
    assert rates(long, fit(long, model, {"quality 1, toxic 1": 1.0})).first().words == 300_000


def descended(words, p, targets, floor=0.0, steps=20_000):
    """Rates of least squares by plain projected gradient steps, as the brute-force answer."""
    a = (p * (words / words.sum())[:, None]).T
    inverse = np.linalg.inv(a @ p)
    r = np.ones(len(words))
    for _ in range(steps):
        r = np.maximum(floor, r - p @ (inverse @ (a @ r - targets)))
    return a @ r, r


@pytest.mark.parametrize("targets", [{"quality 1, toxic 0": 1.0}, {"quality 0, toxic 0": 0.9, "quality 1, toxic 1": 0.1}])
def test_rates_are_those_of_nonnegative_least_squares(tables, targets):
    docs, known, _, _ = tables
    found = fit(docs, train(docs, known), targets)
    out = [x for x in rates(docs, found).collect() if x.words]
    words, p = np.array([x.words for x in out], dtype=float), np.array([x.posterior for x in out])
    totals, r = descended(words, p, found.targets)
    assert np.abs(found.totals - totals).max() < 0.05
    got = np.array([x.rate for x in out])
    assert got.min() == r.min() == 0


def test_keeping_all_keeps_every_document(spark, tables):
    docs, known, rows, _ = tables
    model = train(docs, known)
    targets = {"quality 1, toxic 0": 0.5, "quality 1, toxic 1": 0.5}
    more = fit(docs, model, targets, keep_all=True)
    out = rates(docs, more).collect()
    assert min(x.rate for x in out) >= 1 and min(x.copies for x in out) >= 1
    now = fit(docs, model, {d: 1.0 for d in model.domains}, keep_all=True)
    kept = {d: more.totals[k] for k, d in enumerate(model.domains)}
    assert kept["quality 1, toxic 0"] == pytest.approx(kept["quality 1, toxic 1"], rel=0.05)
    assert more.targets[0] == pytest.approx(kept["quality 0, toxic 0"], abs=5e-3) and now.totals.sum() > 1
    unlisted = fit(docs, model, {"x": 1.0}, keep_all=True)
    assert all(x.rate == 1 for x in rates(docs, unlisted).collect())


def test_dotted_names_stay(spark, tables):
    docs, known, _, _ = tables
    odd = docs.withColumnRenamed("words", "a.b").withColumnRenamed("rate", "c`d")
    found = fit(odd, train(odd, known), {"quality 1, toxic 0": 1.0}, keep_all=True)
    assert mixed(odd, found).columns == odd.columns and mixed(odd, found).count() >= odd.count()


def penalized(words, p, targets, closeness, steps=3000):
    """Rates of the least squared miss plus closeness times the squared distance from 1, by accelerated gradient steps."""
    t = words / words.sum()
    a = (p * t[:, None]).T
    inverse = np.linalg.inv(a @ p)
    r = y = np.ones(len(words))
    speed = (1 - closeness**0.5) / (1 + closeness**0.5)
    for _ in range(steps):
        new = np.maximum(0, y - (p @ (inverse @ (a @ y - targets)) + closeness * (y - 1)) / (1 + closeness))
        r, y = new, new + speed * (new - r)
    return r


def test_rates_where_no_rates_meet_the_targets(tables):
    docs, known, _, _ = tables
    found = fit(docs, train(docs, known), {"quality 1, toxic 0": 1.0})
    assert not found.met
    out = [x for x in rates(docs, found).collect() if x.words]
    words, p = np.array([x.words for x in out], dtype=float), np.array([x.posterior for x in out])
    r = penalized(words, p, found.targets, 1e-3)
    assert np.allclose([x.rate for x in out], r, atol=1e-3)
    assert np.allclose(found.totals, (p * (words / words.sum())[:, None]).T @ r, atol=1e-4)


def test_targets_of_a_few_documents_are_met(tables):
    docs, known, _, _ = tables
    model = train(docs, known)
    out = [x for x in rates(docs, fit(docs, model, {"quality 1, toxic 0": 1.0})).collect() if x.words]
    words, p = np.array([x.words for x in out], dtype=float), np.array([x.posterior for x in out])
    pure = words * (p[:, 1] >= np.quantile(p[:, 1], 0.97))
    found = fit(docs, model, dict(zip(model.domains, (pure @ p / pure.sum()).tolist())))
    assert found.met and np.abs(found.totals - pure @ p / pure.sum()).max() <= 1e-4
    assert found.rates(words, p) @ (p * (words / words.sum())[:, None]) == pytest.approx(found.totals, abs=1e-6)


def test_steps_send_no_classifier(spark, tables, monkeypatch):
    """What is over 1 MB of a task's code is written to files as a broadcast; only the first pass needs the classifier."""
    docs, known, _, _ = tables
    model, sent = train(docs, known), []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or broadcast(x))
    fit(docs, model, {"quality 1, toxic 0": 1.0})
    assert len(sent) <= 1
