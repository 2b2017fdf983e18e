import random
from collections import defaultdict

import pytest

from sampleflow.llm import repeats
from sampleflow.llm.repeats import remove_spans, substring_repeats, suffix_repeats

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def covered(starts, width):
    spans = []
    for p in sorted(starts):
        if spans and p <= spans[-1][1]:
            spans[-1][1] = p + width
        else:
            spans.append([p, p + width])
    return [tuple(s) for s in spans]


def brute(texts, width):
    """doc_id -> (repeated, removed), by comparing every window with every other."""
    places = defaultdict(set)
    for i, t in texts.items():
        words = (t or "").split()
        for p in range(len(words) - width + 1):
            places[tuple(words[p : p + width])].add((i, p))
    many, later = defaultdict(set), defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for i, p in at:
                many[i].add(p)
                if (i, p) != min(at):
                    later[i].add(p)
    return {i: (covered(many[i], width), covered(later[i], width)) for i in many}


def corpus(seed, n=40, vocabulary=60):
    r = random.Random(seed)
    passages = [[f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(8, 60))] for _ in range(5)]
    texts = {}
    for i in range(n):
        words = [f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(0, 70))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(passages)
        texts[i] = r.choice([" ", "\n", "  "]).join(words)
    texts[n], texts[n + 1], texts[n + 2] = "", None, " ".join(["again"] * 400)
    texts[n + 3] = texts[0]
    return texts


def found(df):
    return {r.doc_id: ([tuple(s) for s in r.repeated], [tuple(s) for s in r.removed]) for r in df.collect()}


@pytest.mark.parametrize("width", [2, 7, 12])
def test_spans_are_those_of_brute_force(spark, width):
    texts = corpus(width)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    want = brute(texts, width)
    assert found(substring_repeats(docs, width)) == want
    assert found(suffix_repeats(docs, width)) == want
    if width > 3:
        assert found(suffix_repeats(docs, width, base=2)) == want
    assert len(want) > 5


def test_longest_level_of_a_copy(spark):
    r = random.Random(5)
    text = " ".join(f"u{r.random()}" for _ in range(2000))
    docs = spark.createDataFrame([(1, text, None, None, None), (2, text, None, None, None)], SCHEMA)
    longest = {x.doc_id: x.longest for x in substring_repeats(docs, 50).collect()}
    assert longest[1] == longest[2] == 1600


def longest_by_hand(texts, width):
    """doc_id -> greatest level at which a window of the document is repeated."""
    out, level = {}, width
    while more := brute(texts, level):
        out |= dict.fromkeys(more, level)
        level *= 2
    return out


@pytest.mark.parametrize("width", [2, 7, 12])
def test_longest_is_that_of_brute_force(spark, width):
    texts = corpus(width + 100)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    want = longest_by_hand(texts, width)
    assert {x.doc_id: x.longest for x in substring_repeats(docs, width).collect()} == want
    assert len(set(want.values())) > 2


def test_longest_of_passages_at_each_level(spark):
    r = random.Random(8)
    words = lambda n: [f"v{r.random()}" for _ in range(n)]
    texts = {}
    for size in (50, 51, 99, 100, 100, 100, 101, 105, 110, 199, 200, 200, 201, 399, 400, 401):
        passage = words(size)
        for _ in range(2):
            texts[len(texts)] = " ".join(words(r.randrange(40)) + passage + words(r.randrange(40)))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    assert {x.doc_id: x.longest for x in substring_repeats(docs).collect()} == longest_by_hand(texts, 50)


def test_a_window_goes_on_in_its_own_text(spark):
    r = random.Random(9)
    a, b, c, d = ([f"v{r.random()}" for _ in range(50)] for _ in range(4))
    # Two texts of doc_id 1 hold a and b at places that would follow each other in one text.
    texts = [(1, a + c), (1, d + b), (2, a + b), (3, a + b + d)]
    docs = spark.createDataFrame([(i, " ".join(t), None, None, None) for i, t in texts], SCHEMA)
    assert {x.doc_id: x.longest for x in substring_repeats(docs).collect()} == {1: 50, 2: 100, 3: 100}


def test_removal_keeps_rows_and_columns(spark):
    r = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rest = lambda k: " ".join(f"{k}{r.random()}" for _ in range(30))
    rows = [
        (1, rest("a") + " " + passage, "en", "x", 5),
        (2, passage + "\n\n" + rest("b"), None, "x", 6),
        (2, None, None, None, None),
        (3, passage, "en", "y", 7),
        (None, passage, "en", "y", 8),
        (4, "clean  text ", "en", "y", 9),
        (5, None, "en", "y", None),
        (6, "", "en", None, 0),
    ]
    docs = spark.createDataFrame([(*x, i, i) for i, x in enumerate(rows)], SCHEMA + ", _cut int, removed int")
    for operator in (substring_repeats, suffix_repeats):
        out = remove_spans(docs, operator(docs, 50))
        assert out.columns == docs.columns
        got = {x._cut: x for x in out.collect()}
        assert set(got) == {0, 1, 2, 4, 5, 6, 7}  # 3 held nothing else
        assert got[1].text == rows[1][1].split("\n\n")[1] and got[1].n_chars == len(got[1].text)
        for i in (0, 2, 4, 5, 6, 7):
            assert tuple(got[i])[:5] == rows[i]


def test_odd_column_names_stay(spark):
    text = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, 1, 2), (2, text + " and more", 3, 4)], "doc_id bigint, text string, `a.b` int, `c``d` int")
    out = remove_spans(docs, suffix_repeats(docs))
    assert out.columns == docs.columns and sorted(tuple(x) for x in out.collect()) == [(1, text, 1, 2), (2, "and more", 3, 4)]


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_repeats(empty).collect() == suffix_repeats(empty).collect() == []
    assert remove_spans(empty, suffix_repeats(empty)).collect() == []
    text = " ".join(str(i) for i in range(200_000))
    docs = spark.createDataFrame([(1, text + " x", None, None, None), (2, "y " + text, None, None, None), (1, text + " x", None, None, None)], SCHEMA)
    for operator in (substring_repeats, suffix_repeats):
        assert found(operator(docs, 50)) == {1: ([(0, 200_000)], []), 2: ([(1, 200_001)], [(1, 200_001)])}


def test_ranks_double_in_several_rounds(spark, monkeypatch):
    lengths = []
    following = repeats._next
    monkeypatch.setattr(repeats, "_next", lambda n, length, step, spans, level: lengths.append((length, step)) or following(n, length, step, spans, level))
    r = random.Random(3)
    words = lambda n: [f"v{r.random()}" for _ in range(n)]
    passages = [words(k) for k in (49, 50, 51, 120)]
    texts = {i: " ".join(words(r.randrange(30)) + passages[i % 4] + words(r.randrange(30))) for i in range(12)}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    assert found(suffix_repeats(docs)) == brute(texts, 50)
    assert lengths == [(8, 8), (16, 16), (32, 18), (50, None)]
    unique = spark.createDataFrame([(i, " ".join(words(60)), None, None, None) for i in range(3)], SCHEMA)
    lengths.clear()
    assert found(suffix_repeats(unique)) == {} and lengths == [(8, 8)]  # until all are unique


def test_copies_and_passages_that_very_many_share(spark):
    """A third of the rows are one text, another third share a passage; rows are repeated, ids have several texts."""
    r = random.Random(6)
    words = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    one, passage = " ".join(words(130)), words(60)
    rows = [(3 * i, one) for i in range(60)] + [(3 * i + 1, " ".join(words(20) + passage + words(20))) for i in range(60)] + [(3 * i + 2, " ".join(words(70))) for i in range(60)]
    rows += rows[:5] + rows[60:65] + [(1, one), (500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    places = defaultdict(set)
    for i, t in set(rows):
        w = (t or "").split()
        for p in range(len(w) - 49):
            places[tuple(w[p : p + 50])].add((i, p))
    many, later = defaultdict(set), defaultdict(set)
    for at in places.values():
        for i, p in at if len(at) > 1 else ():
            many[i].add(p)
            if (i, p) != min(at):
                later[i].add(p)
    want = {i: (covered(many[i], 50), covered(later[i], 50)) for i in many}
    assert found(suffix_repeats(docs)) == found(substring_repeats(docs)) == want


def test_arguments(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (lambda: substring_repeats(empty, 1), lambda: suffix_repeats(empty, 1), lambda: suffix_repeats(empty, 9, base=9)):
        with pytest.raises(ValueError):
            f()
