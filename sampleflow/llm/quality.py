"""Quality rules: gradient-boosted trees over statistics of a document.

Two models are trained on labelled documents: that the quality is 0, and that the
document is toxic. A document is rejected when either is likelier than its limit.
Training reads the ``max_rows`` labelled documents (a bound on what the driver
holds) whose doc_id hashes least; half of them give the word beginnings that mark
toxic text, the other half the trees. The trees are flattened into node arrays and all documents
are scored with numpy, whole texts, in one pass without a shuffle.

Defined cases: null and empty texts have statistics of 0 and are rejected (reason
"empty"). Null doc_ids are scored as any other row. Labels that are null, or whose
doc_id is null or unknown, aren't used; of a doc_id that has several the least
quality and the greatest toxic count. Repeated rows get equal scores. Extra columns
stay. Very long texts are taken whole. A score equal to its limit rejects; labels of equal
hashes are ordered by doc_id. An empty table has no scores. If only one class is labelled,
or none, that model rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .spread import bounded_batches

#: Name, and the direction in which it may only move the odds of rejection (0: any).
STATISTICS = {
    "words": (0, 0), "word_bytes": (0, 0), "line_words": (0, 0),
    "upper": (1, 0), "symbols": (1, 0), "digits": (0, 0), "bars": (0, 0), "marked_words": (1, 0), "upper_words": (1, 0),
    "top_word": (1, 0), "doubled": (1, 0), "distinct": (-1, 0), "repeated_grams": (1, 0), "repeated_lines": (1, 0),
    "marks": (0, 1), "mark_share": (0, 1),
}

_B = np.arange(256)
_UPPER, _DIGIT, _BAR = (_B >= 65) & (_B <= 90), (_B >= 48) & (_B <= 57), _B == 124
_SYMBOL = np.isin(_B, [ord(x) for x in "!#$%&*@^~=<>{}[]_\\+"])
_LETTER = (_B >= 97) & (_B <= 122) | _UPPER | (_B >= 0xC3)
_LOWER = np.where(_UPPER, _B + 32, _B).astype(np.uint64)


def beginnings(c: flat.Chunk) -> list[np.ndarray]:
    """The first 4, 5 and 6 bytes of each word as numbers, ASCII in lower case; 0 where it is shorter."""
    code, out = np.zeros(len(c.start), dtype=np.uint64), []
    for k in range(6):
        at = c.start + k
        has = at < c.end
        byte = _LOWER[c.data[np.minimum(at, len(c.data) - 1)]] if len(at) else code
        code = np.where(has, code | (byte << np.uint64(8 * k)), np.uint64(0))
        if k >= 3:
            out.append(code)
    return out


def _distinct(own: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, how many different hashes, and how often the commonest."""
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    begin = np.flatnonzero(new)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, own[begin], np.diff(np.append(begin, len(h))))
    return np.bincount(own[begin], minlength=n), most


def statistics(c: flat.Chunk, lexicon: np.ndarray) -> np.ndarray:
    """One row a text, one column for each of STATISTICS."""
    n, counts = len(c.rows), c.counts.astype(np.float64)
    own, w = c.owner(), c.words()
    some, size = np.maximum(counts, 1), np.maximum(np.diff(c.cuts), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[c.cuts])

    d = c.data
    upper = _UPPER[d]
    upper[1:] |= (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E)
    letters = np.maximum(share(_LETTER[d]), 1)
    last = d[c.end - 1] if len(c.end) else d[:0]
    first = upper[c.start] | upper[np.minimum(c.start + 1, len(d) - 1)] if len(c.start) else upper[:0]
    tail = (upper[np.maximum(c.end - 3, 0)] | _SYMBOL[last]) & (c.end - c.start > 2) if len(c.end) else upper[:0]
    lines = share(d == 10) + 1.0
    distinct, most = _distinct(own, w, n)
    grams = flat.windows(w, 3)
    at = flat.inside(c.counts, 3)[: len(grams)]
    different, _ = _distinct(own[: len(grams)][at], grams[at], n)
    g = np.bincount(own[: len(grams)][at], minlength=n)
    same = np.zeros(len(w), dtype=bool)
    same[1:] = (w[1:] == w[:-1]) & (own[1:] == own[:-1])
    # a line's words: cut where a newline stands between two words
    feed = np.append(0, np.cumsum(d == 10))
    opens = np.ones(len(w), dtype=bool)
    opens[1:] = (own[1:] != own[:-1]) | (feed[c.start[1:]] != feed[c.start[:-1]])
    line = np.flatnonzero(opens)
    sums = flat.word_sums(w)
    ends = np.append(line[1:], len(w))
    key = (sums[ends] - sums[line]) * flat._powers(flat._WORD_BASE, len(sums))[1][line] if len(line) else w[:0]
    kinds, _ = _distinct(own[line], flat.mix(key + (ends - line).astype(np.uint64)), n)
    full = np.bincount(own[line], minlength=n)
    marked = np.zeros(len(w), dtype=bool)
    for code in beginnings(c):
        marked |= lexicon[np.searchsorted(lexicon, code) % len(lexicon)] == code if len(lexicon) else False

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(own, weights=mask, minlength=n)

    marks = of_words(marked)
    return np.column_stack([
        counts, np.bincount(own, weights=c.end - c.start, minlength=n) / some, counts / lines,
        share(upper) / letters, share(_SYMBOL[d]) / size, share(_DIGIT[d]) / size, share(_BAR[d]) / some, of_words(_SYMBOL[last]) / some, of_words(first & tail) / some,
        most / some, of_words(same) / some, distinct / some, 1 - different / np.maximum(g, 1) * (g > 0) - (g == 0), (full - kinds) / np.maximum(full, 1),
        marks, marks / some,
    ])


class Trees:
    """Boosted trees as node arrays: node i goes to left[i] when x[feature[i]] <= threshold[i], else to
    left[i] + 1; a leaf points at itself. The roots are ``roots``."""

    def __init__(self, base: float, depth: int, roots: list[int], feature: list[int], threshold: list[float], left: list[int], value: list[float]):
        self.base, self.depth = base, depth
        self.roots, self.feature, self.left = (np.array(x, dtype=np.int32) for x in (roots, feature, left))
        self.threshold, self.value = np.array(threshold), np.array(value)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            leaf = np.isinf(self.threshold[at])
            at = self.left[at] + (~leaf & (x[rows, self.feature[at]] > self.threshold[at]))
        return self.base + self.value[at].sum(axis=1)

    def likely(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(x)))


def fit(x: np.ndarray, y: np.ndarray, direction: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosts logistic loss. ``direction`` of a feature is 1 or -1 if the odds may only rise or fall with it:
    a split on it must order its leaves so, and all below stay on their side of the middle."""
    n, k = x.shape if len(x) else (0, len(direction))
    rate_of = float(np.mean(y)) if n else 0.0
    if not 0 < rate_of < 1:
        return Trees(-30.0 if rate_of == 0 else 30.0 if n else -30.0, 1, [0], [0], [np.inf], [0], [0.0])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(k)]
    code = np.column_stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(k)])
    width = bins + 1
    flat_code = code + np.arange(k) * width
    base = float(np.log(rate_of / (1 - rate_of)))
    odds = np.full(n, base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        value.append(0.0)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(node())
        work = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while work:
            at, rows, low, high, level = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[at] = float(np.clip(g / (h + ridge), low, high)) * rate
            odds[rows] += value[at]
            if level == depth or len(rows) < 2:
                continue
            which = flat_code[rows].ravel()
            gs = np.bincount(which, weights=np.repeat(grad[rows], k), minlength=k * width).reshape(k, width).cumsum(axis=1)[:, :-1]
            hs = np.bincount(which, weights=np.repeat(hess[rows], k), minlength=k * width).reshape(k, width).cumsum(axis=1)[:, :-1]
            lv, rv = np.clip(gs / (hs + ridge), low, high), np.clip((g - gs) / (h - hs + ridge), low, high)
            score = lambda v, a, b: 2 * v * a - v * v * (b + ridge)
            gain = score(lv, gs, hs) + score(rv, g - gs, h - hs) - score(np.clip(g / (h + ridge), low, high), g, h)
            enough = (hs * 4 >= least) & ((h - hs) * 4 >= least)
            turn = np.array(direction)[:, None]
            enough &= (turn == 0) | ((rv - lv) * turn >= 0)
            gain = np.where(enough, gain, 0.0)
            f, b = divmod(int(gain.argmax()), width - 1)
            if gain[f, b] <= 1e-9 or b >= len(cuts[f]):
                continue
            odds[rows] -= value[at]
            value[at] = 0.0
            middle = (lv[f, b] + rv[f, b]) / 2
            goes = code[rows, f] <= b
            feature[at], threshold[at] = f, float(cuts[f][b])
            left[at] = node()
            node()
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[direction[f]]
            for side, part, (lo, hi) in ((0, rows[goes], bounds[0]), (1, rows[~goes], bounds[1])):
                work.append((left[at] + side, part, lo, hi, level + 1))
    return Trees(base, depth, roots, feature, threshold, left, value)


class Rules:
    """Both models, with the word beginnings they count."""

    def __init__(self, lexicon: np.ndarray, junk: Trees, toxic: Trees):
        self.lexicon, self.junk, self.toxic = lexicon, junk, toxic

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        junk, toxic = [np.zeros(0)], [np.zeros(0)]
        for c in flat.chunks(texts):
            x = statistics(c, self.lexicon)
            for model, out in ((self.junk, junk), (self.toxic, toxic)):
                out.append(np.where(c.counts > 0, model.likely(x), 1.0 if model is self.junk else 0.0))
        return np.concatenate(junk), np.concatenate(toxic)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least_docs: int = 6, purity: float = 0.9) -> Rules:
    """max_rows bounds the labelled documents that are read. A word beginning marks toxic text if in at
    least least_docs documents of the first half, of which the share ``purity`` is toxic."""
    bounded_batches(docs.sparkSession)
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.where("quality is not null or toxic is not null").withColumn("half", F.xxhash64("label_id"))
    own = own.orderBy("half", "label_id").limit(max_rows)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(own), "label_id").select("text", "label_id", "quality", "toxic", F.expr("pmod(half, 2) = 0").alias("first"))  # at most max_rows rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            found = [np.zeros((0, 2), dtype=np.int64)]
            for c in flat.chunks(batch.column(0)):
                known = np.nan_to_num(toxic[c.rows.start : c.rows.stop], nan=0).astype(np.int64)
                ids = c.owner()
                for code in beginnings(c):
                    order = np.lexsort((ids, code))
                    k, o = code[order], ids[order]
                    keep = k != 0
                    keep[1:] &= (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                    found.append(np.column_stack([k[keep].view(np.int64), known[o[keep]]]))
            all_of = np.concatenate(found)
            keys, whose = np.unique(all_of[:, 0], return_inverse=True)
            yield pa.RecordBatch.from_pydict({"code": keys, "toxic": np.bincount(whose, weights=all_of[:, 1], minlength=len(keys)).astype(np.int64), "docs": np.bincount(whose, minlength=len(keys))})

    counted = rows.where("first").mapInArrow(count, "code bigint, toxic bigint, docs bigint").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    marks = counted.where(f"docs >= {least_docs} and toxic >= {purity} * docs").toPandas()
    lexicon = np.sort(marks["code"].to_numpy(dtype=np.int64).view(np.uint64))
    names = list(STATISTICS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, len(names))), *(statistics(c, lexicon) for c in flat.chunks(batch.column(0)))])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(len(names))), *batch.columns[1:4]], names=[*names, "label_id", "quality", "toxic"])

    table = rows.where("not first").mapInArrow(measure, ", ".join(f"{k} double" for k in names) + ", label_id bigint, quality int, toxic int").toPandas()
    table = table.sort_values(["label_id", *names], kind="stable")  # the same trees from the same rows in any order

    def model(y, which: int) -> Trees:
        has = y.notna().to_numpy()
        return fit(table[names].to_numpy()[has], y[has].to_numpy(dtype=float), [STATISTICS[k][which] for k in names])

    return Rules(lexicon, model(1 - table["quality"], 0), model(table["toxic"], 1))


def scored(docs: DataFrame, rules: Rules) -> DataFrame:
    """``docs`` with _score, the probabilities of junk and toxic."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<junk:double,toxic:double>")
    def score(text: pa.Array) -> pa.Array:
        junk, toxic = rules.score(text)
        return pa.StructArray.from_arrays([pa.array(junk), pa.array(toxic)], ["junk", "toxic"])

    name = "_score"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    return docs.withColumn(name, score(F.col("text").cast("string")))


def accepted(docs: DataFrame, rules: Rules, junk: float = 0.5, toxic: float = 0.5) -> DataFrame:
    """The documents that neither model rejects, with their own columns."""
    out = scored(docs, rules)
    score = out.columns[-1]
    return out.where((F.col(score)["junk"] < junk) & (F.col(score)["toxic"] < toxic)).drop(score)


def accepted_scores(docs: DataFrame, rules: Rules, junk: float = 0.5, toxic: float = 0.5) -> DataFrame:
    """(doc_id, junk, toxic) of the documents that neither model rejects."""
    out = scored(docs.select("doc_id", "text"), rules)
    score = out.columns[-1]
    return out.select("doc_id", F.col(score)["junk"].alias("junk"), F.col(score)["toxic"].alias("toxic")).where((F.col("junk") < junk) & (F.col("toxic") < toxic))
