"""Mixing documents to target weights of soft domains.

A classifier trained on a labelled table gives each document a posterior over the
domains, which are the combinations of the label columns that occur ("quality 1,
toxic 0"). Document i with t words and posterior p adds rate * t * p[d] expected
words to domain d; nonnegative rates are fitted so that the domains' totals meet the
targets. Of the rates that do, those are taken that are nearest to 1 (least sum of
t * (rate - 1) ** 2, so that a rate depends on the posterior and not on the length).
If none do, those with the least squared miss, whitened by the inverse of the sum of
t * p p', plus ``closeness`` times that distance from 1: the squared miss alone would
be least for a few documents repeated very often.

Either way the rate is max(0, 1 - p . g) for one number g[d] a domain, found by Newton's
method on the dual, which is convex. Each step sums over all documents in Spark and
takes a few numbers there; a document's rate follows from its text alone, and applying
the rates needs neither a join nor a shuffle.

The classifier is naive Bayes over word beginnings, word ends and doubled words, put
through softmax regression. ``max_rows`` bounds the labelled documents that it reads
(those whose doc_id hashes least; one half for each of its parts). All documents are
scored and summed.

Defined cases: null and empty texts have 0 words, the share of domains in the labels
as their posterior, and rate 1. Null doc_ids are documents as any other; equal texts
get equal rates. A target of a domain without labels can't be met: it is left out and
the others are scaled to 1. Without labels every rate is 1. Label rows with a null in
any column aren't used; of a doc_id that has several one is. Very long texts are taken
whole. Equal posteriors get equal rates. An empty table has no rows. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .spread import bounded_batches, table

_BITS = 15
_SIZE = 2 * (1 << _BITS) + 2


def tokens(c: flat.Chunk) -> tuple[np.ndarray, list[np.ndarray]]:
    """The text of each word, and its three buckets."""
    own = c.owner()
    size = c.end - c.start
    top = len(c.data) - 1
    begin, end = np.zeros(len(own), dtype=np.uint64), np.zeros(len(own), dtype=np.uint64)
    for k in range(4):
        at = np.minimum(c.start + k, top)
        begin |= np.where(k < size, c.data[at], 0).astype(np.uint64) << np.uint64(8 * k)
    for k in range(2):
        end |= np.where(k < size, c.data[np.maximum(c.end - 1 - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    shift = np.uint64(64 - _BITS)
    w = c.words()
    same = np.zeros(len(own), dtype=np.int64)
    same[1:] = (w[1:] == w[:-1]) & (own[1:] == own[:-1])
    return own, [(flat.mix(begin) >> shift).astype(np.int64), (1 << _BITS) + (flat.mix(end) >> shift).astype(np.int64), (2 << _BITS) + same]


class Classifier:
    def __init__(self, domains: list[str], shares: np.ndarray, model: np.ndarray, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray):
        self.domains, self.shares, self.model, self.weights, self.centre, self.scale = domains, shares, model, weights, centre, scale

    def features(self, c: flat.Chunk) -> np.ndarray:
        own, buckets = tokens(c)
        n, k = len(c.rows), len(self.domains)
        sums = np.column_stack([sum(np.bincount(own, weights=self.model[b, d] - self.model[b, 0], minlength=n) for b in buckets) for d in range(1, k)]) if k > 1 else np.zeros((n, 0))
        counts = c.counts
        return np.column_stack([np.sign(sums) * np.log1p(np.abs(sums)), sums / np.maximum(counts, 1)[:, None], np.log1p(counts)])

    def posterior(self, c: flat.Chunk) -> np.ndarray:
        p = softmax((self.features(c) - self.centre) / self.scale, self.weights)
        p[c.counts == 0] = self.shares
        return p


def softmax(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of probabilities; the weights of the first class are 0, each row's last weight is the constant."""
    odds = np.column_stack([np.zeros(len(x)), x @ weights[:, :-1].T + weights[:, -1]])
    odds -= odds.max(axis=1, keepdims=True)
    p = np.exp(odds)
    return p / p.sum(axis=1, keepdims=True)


def regression(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton's method for softmax regression with classes 0 ... k - 1."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros((k - 1, z.shape[1]))
    hot = (y[:, None] == np.arange(1, k)).astype(float)
    loss = lambda w: -np.log(np.maximum(softmax(x, w)[np.arange(len(y)), y], 1e-300)).sum() + ridge / 2 * (w**2).sum()
    now = loss(w)
    for _ in range(steps):
        p = softmax(x, w)[:, 1:]
        grad = (p - hot).T @ z + ridge * w
        hess = np.block([[z.T @ (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]) for b in range(k - 1)] for a in range(k - 1)]) if k > 1 else np.zeros((0, 0))
        step = np.linalg.solve(hess + ridge * np.eye(len(hess)), grad.ravel()).reshape(w.shape)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * abs(now):
            break
    return w


def train(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("quality", "toxic"), max_rows: int = 20_000) -> Classifier | None:
    bounded_batches(docs.sparkSession)
    name = F.concat_ws(", ", *(F.concat(F.lit(c + " "), F.col(c).cast("string")) for c in columns))
    own = labels.where(" and ".join(f"{c} is not null" for c in ("doc_id", *columns))).groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(F.min(name).alias("domain"))
    own = own.withColumn("h", F.xxhash64("label_id")).orderBy("h", "label_id").limit(max_rows)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(own), "label_id").select("text", "label_id", "domain", F.expr("pmod(h, 2) = 0").alias("first"))  # at most max_rows rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(2).to_pylist(), dtype=str)
            for c in flat.chunks(batch.column(0)):
                own, buckets = tokens(c)
                for d in np.unique(names[c.rows.start : c.rows.stop]).tolist():
                    is_d = (names[c.rows.start : c.rows.stop] == d)[own]
                    sums[d] = sums.get(d, 0) + sum(np.bincount(b[is_d], minlength=_SIZE) for b in buckets)
        for d, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["domain", "bucket", "n"])

    counted = rows.where("first").mapInArrow(count, "domain string, bucket bigint, n bigint").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()
    domains = sorted(set(counted["domain"]))
    if not domains:
        return None
    model = np.full((_SIZE, len(domains)), 0.5)
    for k, d in enumerate(domains):
        part = counted[counted["domain"] == d]
        model[part["bucket"].to_numpy(), k] += part["n"].to_numpy()
    for low, high in ((0, 1 << _BITS), (1 << _BITS, 2 << _BITS), (2 << _BITS, _SIZE)):
        model[low:high] = np.log(model[low:high] / model[low:high].sum(axis=0))
    size = 2 * (len(domains) - 1) + 1
    raw = Classifier(domains, np.zeros(0), model, np.zeros(0), np.zeros(size), np.ones(size))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, size)), *(raw.features(c) for c in flat.chunks(batch.column(0)))])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(size)), batch.column(1), batch.column(2)], names=[*(f"x{k}" for k in range(size)), "label_id", "domain"])

    found = rows.where("not first").mapInArrow(measure, ", ".join(f"x{k} double" for k in range(size)) + ", label_id bigint, domain string").toPandas()
    found = found[found["domain"].isin(domains)].sort_values(["label_id", "x0"], kind="stable")
    y = found["domain"].map(domains.index).to_numpy(dtype=np.int64)
    x = found[[f"x{k}" for k in range(size)]].to_numpy()
    centre, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(size), np.ones(size))
    scale = np.where(scale > 0, scale, 1.0)
    shares = (np.bincount(y, minlength=len(domains)) + 1.0) / (len(y) + len(domains))
    return Classifier(domains, shares, model, regression((x - centre) / scale, y, len(domains)), centre, scale)


class Fit:
    """The steps of the fit, each a number a domain, and how far the totals are from the targets.
    No rate is below ``floor`` in the end; ``met``: whether the totals are those of the targets, within the tolerance."""

    def __init__(self, classifier: Classifier | None, scale: float, steps: list[np.ndarray], totals: np.ndarray, targets: np.ndarray, floor: float = 0.0):
        self.classifier, self.scale, self.steps, self.totals, self.targets, self.floor, self.met = classifier, scale, steps, totals, targets, floor, True

    def rates(self, words: np.ndarray, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(words))
        for g in self.steps:
            r = np.maximum(0.0, r - p @ g)
        r = np.maximum(self.floor, r)
        return np.where(words > 0, r, 1.0)


class Sums:
    """Over all rows, with the rates of a point g: half the sum of t * rate ** 2, the sums of t * rate * x and, where the
    rate is above 0, of t * x x', and the least x . g. x is the posterior in a basis, t the share of all words."""

    def __init__(self, sums: np.ndarray, least: float):
        k = int(len(sums) ** 0.5)
        self.half, self.totals, self.active, self.least = float(sums[0]), sums[1 : k + 1], sums[k + 1 :].reshape(k, k), least


def sums_at(rows: DataFrame, scale: float, basis: np.ndarray, points: np.ndarray) -> list[Sums]:
    """The sums at each of the points, in one pass over the rows (words, posterior). What is sent to the tasks are the arguments alone."""
    n, k = points.shape
    width = 1 + k + k * k

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, least = np.zeros((n, width)), np.full(n, np.inf)
        for batch in batches:
            words, *p = (x.to_numpy() for x in batch.columns)
            t, x = words / scale, np.column_stack(p) @ basis
            for i, g in enumerate(points):
                along = x @ g
                r = np.maximum(0.0, 1.0 - along)
                y, u = x[r > 0], t[r > 0]
                sums[i] += np.concatenate([[t @ (r * r) / 2], (t * r) @ x, ((u[:, None] * y).T @ y).ravel()])
                least[i] = min(least[i], along.min(initial=np.inf))
        yield pa.RecordBatch.from_pydict({"at": np.arange(n * width + n, dtype=np.int32), "x": np.concatenate([sums.ravel(), least])})

    got = {r.at: r for r in rows.mapInArrow(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"), F.min("x").alias("least")).collect()}
    return [Sums(np.array([got[i * width + j].x for j in range(width)]), got[n * width + i].least) for i in range(n)]


def nearest(sums: Callable[[np.ndarray], list[Sums]], goal: np.ndarray, closeness: float, point: np.ndarray, here: Sums) -> tuple[np.ndarray, Sums]:
    """The least of half the sum of t * rate ** 2, plus goal . g, plus closeness / 2 * g . g, by Newton's method from ``point``, and
    its sums; there, totals - goal = closeness * g. ``sums`` sees steps of several sizes at once."""
    value = lambda g, s: s.half + goal @ g + closeness / 2 * (g @ g)
    while True:
        now, slope = value(point, here), goal - here.totals + closeness * point
        step = -np.linalg.solve(here.active + closeness * np.eye(len(goal)), slope)
        gain = -(slope @ step)
        if gain <= max(1e-10, 1e-14 * abs(now)):
            return point, here
        sizes, found = 2.0 ** -np.arange(12), None
        while found is None:
            if sizes[0] < 1e-12:  # less than rounding can tell
                return point, here
            tried = point + sizes[:, None] * step
            found = next(((g, s) for size, g, s in zip(sizes, tried, sums(tried)) if value(g, s) <= now - 1e-4 * size * gain), None)
            sizes = sizes / 2.0**12
        point, here = found


def fit(docs: DataFrame, classifier: Classifier | None, targets: Mapping[str, float], keep_all: bool = False, tolerance: float = 1e-4, closeness: float = 1e-3) -> Fit:
    """Rates for the documents; ``targets`` are the domains' shares of the words there are. keep_all: rates
    that come out below 1 are raised to it, and the targets are of as many more words as it takes for no domain to shrink, and 1
    in 1000 on top; domains without a target keep the words they have. ``closeness`` weighs the distance from 1 against the
    squared miss. It is lowered until the totals are within the tolerance of the targets, or until it is proved that those of no rates
    are (or it is under 1e-12, with neither): then ``met`` is False, and the rates are those of the closeness given."""
    if any(w < 0 for w in targets.values()) or sum(targets.values()) <= 0:
        raise ValueError("targets must be nonnegative, and not all 0")
    if classifier is None:
        return Fit(None, 1.0, [], np.zeros(0), np.zeros(0))
    bounded_batches(docs.sparkSession)
    k = len(classifier.domains)
    want = np.array([targets.get(d, 0.0) for d in classifier.domains])
    if want.sum() <= 0 and not keep_all:
        raise ValueError("no target is for a domain that is labelled")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in flat.chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(c.counts.astype(np.float64)), *(pa.array(x) for x in classifier.posterior(c).T)], names=["words", *(f"p{d}" for d in range(k))])

    narrow = table(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(measure, "words double, " + ", ".join(f"p{d} double" for d in range(k))))
    rows = narrow.df.select("words", *(f"p{d}" for d in range(k))).where("words > 0")
    total = rows.agg(F.sum("words")).first()[0] or 0.0
    if total == 0:
        narrow.drop()
        return Fit(classifier, 1.0, [], np.zeros(k), np.zeros(k))
    out = Fit(classifier, float(total), [], np.zeros(k), want / max(want.sum(), 1e-300))
    start = sums_at(rows, out.scale, np.eye(k), np.zeros((1, k)))[0]
    out.totals = start.totals
    if keep_all:
        share = out.targets * (1 - out.totals[want <= 0].sum())
        more = 1.001 * (out.totals / np.where(want > 0, np.maximum(share, 1e-300), np.inf)).max()
        out.targets = np.where(want > 0, share * more, out.totals)
    # A basis in which the sum of t * x x' is 1, of the directions in which there are words.
    size, vectors = np.linalg.eigh(start.active)
    there = size > 1e-12 * size.sum()
    basis, back = vectors[:, there] / np.sqrt(size[there]), vectors[:, there] * np.sqrt(size[there])
    goal = out.targets @ basis

    def proved(point: np.ndarray, s: Sums) -> bool:
        """Whether no rates meet the targets: for a u with p . u >= 0 for all rows, u . totals >= 0 whatever the rates."""
        u = basis @ point - s.least
        return -(u @ out.targets) > tolerance * np.abs(u).sum()

    point = np.zeros(len(goal))
    here, answer = Sums(np.concatenate([[start.half], start.totals @ basis, (basis.T @ start.active @ basis).ravel()]), 0.0), None
    while True:
        point, here = nearest(lambda points: sums_at(rows, out.scale, basis, points), goal, closeness, point, here)
        totals = back @ here.totals
        out.met = bool(np.abs(totals - out.targets).max() <= tolerance)
        if out.met or answer is None:
            answer = basis @ point, totals
        if out.met or proved(point, here) or closeness < 1e-12:
            break
        closeness /= 100
    out.steps, out.totals, out.floor = [answer[0]] * bool(answer[0].any()), answer[1], float(keep_all)
    narrow.drop()
    return out


def measured(text: Column, found: Fit) -> Column:
    """struct<words, posterior, rate> of a text."""

    @F.arrow_udf("struct<words:bigint,posterior:array<double>,rate:double>")
    def run(x: pa.Array) -> pa.Array:
        words, p, rate = [np.zeros(0, np.int64)], [], [np.zeros(0)]
        k = len(found.classifier.domains) if found.classifier else 0
        for c in flat.chunks(x):
            own = found.classifier.posterior(c) if found.classifier else np.zeros((len(c.rows), 0))
            words.append(c.counts)
            p.append(own)
            rate.append(found.rates(c.counts.astype(np.float64), own) if k else np.ones(len(c.rows)))
        flat_p = np.concatenate([np.zeros((0, k)), *p]).ravel()
        lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, pa.array(flat_p))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(words)), lists, pa.array(np.concatenate(rate))], ["words", "posterior", "rate"])

    return run(text.cast("string"))


def copies_of(rate: Column, *identity: Column) -> Column:
    """How often a document is taken: the whole part of its rate, and once more with the probability of
    the rest, decided by a hash of its identity."""
    chance = F.pmod(F.xxhash64(*identity), F.lit(1 << 32)) / float(1 << 32)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")


def rates(docs: DataFrame, found: Fit) -> DataFrame:
    """(doc_id, words, posterior, rate, copies) of each document."""
    out = docs.select("doc_id", "text", measured(F.col("text"), found).alias("m"))
    return out.select("doc_id", "m.words", "m.posterior", "m.rate", copies_of(F.col("m.rate"), F.col("doc_id"), F.col("text")).alias("copies"))


def mixed(docs: DataFrame, found: Fit) -> DataFrame:
    """``docs``, each row as often as its rate says."""
    name = "_mixed"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    out = docs.withColumn(name, measured(F.col("text"), found)["rate"])
    taken = out.withColumn(name, copies_of(F.col(name), F.col("doc_id"), F.col("text"))).where(F.col(name) > 0)
    return taken.withColumn(name, F.explode(F.array_repeat(F.lit(0), F.col(name)))).drop(name)
