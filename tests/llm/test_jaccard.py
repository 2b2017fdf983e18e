import random
from itertools import combinations

import numpy as np
import pytest

from sampleflow.llm import jaccard
from sampleflow.llm.graph import components
from sampleflow.llm.jaccard import first_of_each_group, join_sets, near_classes
from sampleflow.llm.queries import op7_ngram_jaccard_join

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def gram_set(text, n):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(texts, threshold, n):
    """doc_id -> (class_id, links), by comparing every two documents."""
    sets = {i: s for i, t in texts.items() if (s := gram_set(t, n))}
    alike = {i: {i} for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            alike[a].add(b)
            alike[b].add(a)
    out = {}
    for i in sorted(sets):
        if i in out:
            continue
        reached, work = {i}, [i]
        while work:
            more = alike[work.pop()] - reached
            reached |= more
            work += more
        out |= {k: (i, len(alike[k]) - 1) for k in reached}
    return {k: v for k, v in out.items() if v[1]}


def found(df):
    rows = [(x.doc_id, (x.class_id, x.links)) for x in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(40)}"
    texts, k = {}, 0
    for _ in range(25):
        base = [word() for _ in range(r.randrange(1, 60))]
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            copy = [word() if r.random() < r.choice([0, 0.02, 0.1]) else w for w in base]
            texts[k] = " ".join(copy)
            k += 1
    return texts | {k: "", k + 1: None, k + 2: "one", k + 3: "one", k + 4: "one two"}


@pytest.mark.parametrize("threshold,n,block,hot", [(0.6, 3, 2048, 64), (0.8, 1, 3, 2), (0.5, 2, 2, 0), (1.0, 2, 2048, 64), (0.7, 1, 1, 1000)])
def test_classes_are_those_of_brute_force(spark, monkeypatch, threshold, n, block, hot):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "HOT_LEAST", hot)
    texts = corpus(n)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    want = brute(texts, threshold, n)
    assert found(near_classes(docs, threshold, n)) == want
    assert len({c for c, _ in want.values()}) > 3


def test_the_query_counts_every_copy(spark, tmp_path):
    base = " ".join(f"x{i}" for i in range(50))
    rows = [(i, t, None, None, None) for i, t in enumerate([base, base, base, base + " y", base + " y", "something else here"])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(op7_ngram_jaccard_join(spark, str(tmp_path))) == {i: (0, 4) for i in range(5)}


def test_common_grams_link_only_what_may_be_alike(spark, monkeypatch):
    """A third of each text are the same words: the rarest n-grams keep each pair a component of its own."""
    common = [f"c{i}" for i in range(20)]
    texts = [" ".join(common + [f"p{k}_{i}" for k in range(40)] + [f"q{copy}"] * copy) for i in range(150) for copy in range(2)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    for hot in (64, 1000):
        monkeypatch.setattr(jaccard, "HOT_LEAST", hot)
        near = components(jaccard.links(jaccard.sets(docs, 3, 0.6), 0.6)).df.groupBy("root").count().collect()
        assert [x["count"] for x in near] == [2] * 150


@pytest.mark.parametrize("seed", range(20))
def test_derived_overlaps_are_exact(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 300, 80) for _ in range(3)]
    sets = {}
    for _ in range(60):
        s = base[rng.integers(3)].copy()
        s[rng.random(80) < rng.choice([0.02, 0.3])] = 999
        s = np.unique(np.append(s[: rng.integers(20, 81)], rng.integers(0, 5000, 3))).astype(np.uint64)
        sets[s.tobytes()] = s
    parts = list(sets.values())
    want = {(i, j) for i, j in combinations(range(len(parts)), 2) if len(np.intersect1d(parts[i], parts[j])) / len(np.union1d(parts[i], parts[j])) >= 0.6}
    for sides in (np.zeros(len(parts), int), rng.integers(0, 2, len(parts))):
        got = [(min(a, b), max(a, b)) for a, z, _ in join_sets(parts, sides, 0.6) for b in z.tolist()]
        assert len(set(got)) == len(got)
        assert set(got) == {(i, j) for i, j in want if len(set(sides)) == 1 or sides[i] != sides[j]}


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (105, 101), (7, 7), (200, 200), (None, 3), (101, 100)]
    got = {x.node: x.root for x in components(spark.createDataFrame(chain, "a bigint, b bigint")).df.collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 105: 100, 200: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).df.collect() == []


def test_one_of_each_group_stays(spark):
    base = " ".join(f"x{i}" for i in range(50))
    rows = [(4, base, "en", "s", 1), (2, base + " y", None, "s", 2), (2, base + " y", None, "s", 2), (9, "clean text here", "en", None, 3), (None, base, "en", "s", 4), (5, None, None, None, None)]
    docs = spark.createDataFrame([(*x, i, 0) for i, x in enumerate(rows)], SCHEMA + ", node int, root int")
    out = first_of_each_group(docs, near_classes(docs))
    assert out.columns == docs.columns
    assert sorted(x.node for x in out.collect()) == [1, 2, 3, 4, 5]


def test_empty_and_very_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_classes(empty).collect() == []
    long = " ".join(str(i) for i in range(150_000))
    docs = spark.createDataFrame([(1, long, None, None, None), (2, long + " x", None, None, None), (3, long[:1000], None, None, None)], SCHEMA)
    assert found(near_classes(docs)) == {1: (1, 1), 2: (1, 1)}
    with pytest.raises(ValueError):
        near_classes(empty, 0)


def test_rows_of_one_doc_id(spark):
    base = " ".join(f"x{i}" for i in range(50))
    rows = [(7, base), (7, base), (7, "quite another text of seven words"), (8, base + " y"), (9, "quite another text of seven words"), (None, base)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = sorted(tuple(x) for x in near_classes(docs).collect())
    assert got == [(7, 7, 1), (7, 7, 1), (8, 7, 1), (9, 7, 1)]
