import random

import numpy as np
import pyarrow as pa
import pytest

from sampleflow.llm import flat, quality
from sampleflow.llm.quality import STATISTICS, accepted, accepted_scores, fit, statistics, train

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def measure(*texts):
    x = np.concatenate([statistics(c, np.zeros(0, np.uint64)) for c in flat.chunks(pa.array(texts))])
    return [dict(zip(STATISTICS, row)) for row in x]


def test_statistics_by_hand():
    a, b, c, d = measure("Ab cd cd\nx1 y# |", "", None, "so it is so it is")
    assert (a["words"], a["line_words"], a["top_word"], a["distinct"]) == (6, 3, 2 / 6, 5 / 6)
    assert a["word_bytes"] == 11 / 6 and a["upper"] == 1 / 8 and a["digits"] == 1 / 16 and a["bars"] == 1 / 6 and a["doubled"] == 1 / 6
    assert a["marked_words"] == 1 / 6
    assert set(b.values()) == set(c.values()) == {0.0}
    assert d["repeated_grams"] == pytest.approx(1 / 4) and d["repeated_lines"] == 0


@pytest.mark.parametrize("seed", range(5))
def test_trees_are_monotonic_and_like_a_walk(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(1500, 4))
    y = (x[:, 0] - x[:, 1] + np.sin(3 * x[:, 2]) + rng.normal(size=1500) > 0).astype(float)
    trees = fit(x, y, [1, -1, 0, 1], trees=25)
    assert ((trees.likely(x) > 0.5) == y).mean() > 0.8
    for f, turn in ((0, 1), (1, -1), (3, 1)):
        grid = np.repeat(rng.normal(size=(40, 1, 4)), 30, axis=1)
        grid[:, :, f] = np.linspace(-4, 4, 30)
        assert (np.diff(trees.odds(grid.reshape(-1, 4)).reshape(40, 30), axis=1) * turn >= -1e-12).all()

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while np.isfinite(trees.threshold[at]):
                at = trees.left[at] + (row[trees.feature[at]] > trees.threshold[at])
            total += trees.value[at]
        return total

    assert np.allclose(trees.odds(x[:50]), [walk(r) for r in x[:50]])


def test_one_class_or_none_rejects_nothing():
    for y in (np.zeros(0), np.zeros(5)):
        assert (fit(np.zeros((len(y), 2)), y, [0, 0]).likely(np.zeros((3, 2))) < 0.5).all()


def corpus(n=900):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice("lo mi ta ren sol ka dun per".split()) * r.randrange(1, 3) for _ in range(r.randrange(5, 80))]
        junk, toxic = r.random() < 0.3, r.random() < 0.3
        if junk:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words.insert(r.randrange(len(words)), "grumble")
        docs.append((i, " ".join(words), "xx", "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_defined_cases(spark):
    docs, labels = corpus()
    extra = [(5000, None, None, None, None), (5001, "", None, None, None), (None, docs[0][1], None, None, None)] + [docs[0]] * 2
    have = spark.createDataFrame([(*d, 0, 1) for d in docs + extra], SCHEMA + ", _score int, junk int")
    known = spark.createDataFrame(labels[:600] + [(None, 0, 1), (1, None, None), (99999, 0, 0)], "doc_id bigint, quality int, toxic int")
    rules = train(have, known)
    kept = accepted(have, rules)
    assert kept.columns == have.columns
    ids = [x.doc_id for x in kept.select("doc_id").collect()]
    right = np.mean([(i in ids) == (q == 1 and t == 0) for i, q, t in labels[600:]])
    assert right > 0.97
    assert 5000 not in ids and 5001 not in ids
    assert ids.count(0) in (0, 3) and ids.count(None) == (ids.count(0) == 3)
    assert sorted(map(str, ids)) == sorted(str(x.doc_id) for x in accepted_scores(have, rules).collect())
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert accepted(have, train(have, none)).count() == len(docs) + 3
    empty = spark.createDataFrame([], SCHEMA)
    assert accepted(empty, train(empty, known)).count() == 0


def test_long_text():
    text = "word salad " * 300_000
    junk, toxic = quality.Rules(np.zeros(0, np.uint64), fit(np.zeros((0, 16)), np.zeros(0), [0] * 16), fit(np.zeros((0, 16)), np.zeros(0), [0] * 16)).score(pa.array([text, "a"]))
    assert len(junk) == 2
