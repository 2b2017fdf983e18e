import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sampleflow.llm import flat
from sampleflow.llm.queries import op9_simhash
from sampleflow.llm.simhash import close_classes, close_documents, fingerprints, tables

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def by_hand(text):
    (c,) = flat.chunks(pa.array([text]))
    hashes = dict(zip(text.split(), c.words().tolist()))
    votes = [0] * 64
    for w, n in Counter(text.split()).items():
        for k in range(64):
            votes[k] += (1 if hashes[w] >> k & 1 else -1) * n.bit_length()
    return sum(1 << k for k in range(64) if votes[k] > 0)


def test_fingerprints_by_hand():
    r = random.Random(0)
    texts = [" ".join(f"w{r.randrange(80)}" for _ in range(r.randrange(1, 300))) for _ in range(50)]
    got = [int(p) for c in flat.chunks(pa.array(texts), 3000) for p in fingerprints(c)[1]]
    assert got == [by_hand(t) for t in texts]
    long = " ".join(f"w{r.randrange(70_000)}" for _ in range(100_000))
    (c,) = flat.chunks(pa.array([long]))
    assert int(fingerprints(c)[1][0]) == by_hand(long)


def brute(prints, radius):
    """doc_id -> (class_id, links), by comparing every two documents."""
    alike = {i: {i} for i in prints}
    for a, b in combinations(sorted(prints), 2):
        if bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= radius:
            alike[a].add(b)
            alike[b].add(a)
    out = {}
    for i in sorted(prints):
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


@pytest.mark.parametrize("radius,agree", [(0, 3), (1, 1), (3, 4), (8, 3)])
def test_classes_are_those_of_brute_force(spark, radius, agree):
    r = random.Random(radius)
    prints, ends = {}, []
    for i in r.sample(range(1000), 300):
        p = r.choice(ends) if ends and r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.choice([0, 0, r.randrange(radius + 3)])):
            p ^= 1 << r.randrange(64)
        ends.append(p)
        prints[i] = p - (1 << 64) if p >> 63 else p
    rows = list(prints.items()) + [next(iter(prints.items())), (None, 5), (7000, None)]
    want = brute(prints, radius)
    assert found(close_classes(spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint"), radius, agree)) == want
    assert len(want) > 20
    assert len(tables(radius, agree)) == len(list(combinations(range(radius + agree), agree)))


def test_documents_and_defined_cases(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(500)}" for _ in range(400)]
    near = base[:200] + ["other"] + base[201:]
    texts = [" ".join(base), " ".join(near), " ".join(base), "quite different", "", None, " \n", "x " * 100_000]
    prints = {i: by_hand(t) for i, t in enumerate(texts) if t and t.split()}
    rows = [(i, t, None, None, None, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:1] + [(None, texts[0], None, None, None, 1)], SCHEMA + ", fingerprint int")
    assert found(close_documents(docs)) == brute(prints, 8)
    assert brute(prints, 8)[2] == (0, 2)
    assert close_documents(docs.where("doc_id < 0")).collect() == []
    for wrong in ((-1, 3), (8, 0), (62, 3), (20, 20)):
        with pytest.raises(ValueError):
            tables(*wrong)


def test_the_query_finds_near_copies_of_every_copy(spark, tmp_path):
    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(200)]
    far, distance = base, 0
    while distance < 6:  # a near copy beyond 3 bits, within 8
        far = [w if r.random() < 0.97 else f"z{r.randrange(999)}" for w in base]
        distance = bin(by_hand(" ".join(base)) ^ by_hand(" ".join(far))).count("1")
        distance = distance if distance <= 8 else 0
    texts = [" ".join(x) for x in (base, base, base, far, far)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(op9_simhash(spark, str(tmp_path))) == {i: (0, 4) for i in range(5)}
