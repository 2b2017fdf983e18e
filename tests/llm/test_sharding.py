import math
import random

import pytest

from sampleflow.llm.sharding import shards

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def name(s):
    return -1.0 if s is None else float(int.from_bytes(s.encode()[:6].ljust(6, b"\0"), "big"))


def brute(rows, target):
    """The leaves as sorted lists of row numbers, from left to right."""
    points = []
    for d, t, lang, source, *_ in rows:
        b = len((t or "").encode())
        points.append((b, (math.log2(1 + b), name(source), name(lang), float(-(1 << 62)) if d is None else float(d))))
    extent = lambda ids: [max(points[i][1][k] for i in ids) - min(points[i][1][k] for i in ids) for k in range(4)]
    whole = [e or 1.0 for e in extent(range(len(rows)))]

    def cut(ids):
        total, e = sum(points[i][0] for i in ids), extent(ids)
        if total <= target or max(e) == 0:
            return [sorted(ids)]
        k = max(range(4), key=lambda k: (e[k] / whole[k], -k))
        values = sorted({points[i][1][k] for i in ids})
        upto = 0
        for v in values:
            upto += sum(points[i][0] for i in ids if points[i][1][k] == v)
            if upto >= total / 2:
                break
        if v == values[-1]:
            v = values[-2]
        return cut([i for i in ids if points[i][1][k] <= v]) + cut([i for i in ids if points[i][1][k] > v])

    return cut(list(range(len(rows)))) if rows else []


@pytest.mark.parametrize("target", [300, 2000, 10**9])
def test_shards_are_those_of_brute_force(spark, target):
    r = random.Random(target)
    rows = [(i, "é" * int(r.paretovariate(1) * 5), r.choice(["en", "de", None]), r.choice(["src0"] * 5 + ["src1", "src10", "a", ""]), 0, i, 1) for i in range(150)]
    rows += [(None, None, None, None, None, 150, 1), (5, "", "en", "src0", 0, 151, 1), (7, rows[7][1], rows[7][2], rows[7][3], 0, 152, 1), (500, "x" * 5000, "en", "src0", 0, 153, 1), (501, "y" * 5000, "en", "src0", 0, 154, 1)]
    docs = spark.createDataFrame(rows, SCHEMA + ", shard int, bytes int")
    got = {}
    for x in shards(docs, target).collect():
        got.setdefault(x.shard, []).append((x.doc_id is not None, x.doc_id, x.bytes))
    want = [sorted((rows[i][0] is not None, rows[i][0], len((rows[i][1] or "").encode())) for i in leaf) for leaf in brute(rows, target)]
    assert [sorted(got[k]) for k in sorted(got)] == want
    assert sorted(got) == list(range(len(got)))


def test_equal_rows_stay_whole_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", "en", "s", 3)] * 5, SCHEMA)
    assert {x.shard for x in shards(docs, 4).collect()} == {0}
    assert shards(docs.limit(0), 4).collect() == []
    with pytest.raises(ValueError):
        shards(docs, 0)
