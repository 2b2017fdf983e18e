"""Several datasets as one: one after the other, or interleaved by weight."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..order import POS


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def concat(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of each in turn; columns that one lacks are null there."""
    if not dfs:
        raise ValueError("nothing to concatenate")
    out, before = [], 0
    for k, df in enumerate(dfs):
        out.append(df.withColumn(POS, F.col(POS) + F.lit(before).cast("bigint")) if before else df)
        if k + 1 < len(dfs):
            before += df.count()
    return _union(out)


def stratified_order(weights: Sequence[float], length: int) -> list[int]:
    """Which source each of ``length`` rows is from: every source gains its weight, the first of the
    highest scores is taken and loses 1."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be nonnegative, and not all 0")
    total = sum(weights)
    gain, score, out = [w / total for w in weights], [0.0] * len(weights), []
    for _ in range(length):
        score = [s + g for s, g in zip(score, gain)]
        best = max(range(len(score)), key=lambda k: (score[k], -k))
        score[best] -= 1
        out.append(best)
    return out


def slots(weights: Sequence[float], period: int) -> list[list[int]]:
    """The places of each source within a period."""
    order = stratified_order(weights, period)
    return [[i for i, s in enumerate(order) if s == k] for k in range(len(weights))]


def interleave_need(places: list[list[int]], period: int, n: int) -> list[int]:
    """How many rows of each source are among the first ``n``."""
    return [n // period * len(p) + sum(i < n % period for i in p) for p in places]


def interleave(dfs: Sequence[DataFrame], places: list[list[int]], period: int, counts: Sequence[int | None]) -> DataFrame:
    """Row r of a source goes to the r-th of its places, period after period; the result ends where a
    source lacks a row. A count of None is a source that doesn't end."""
    parts, ends = [], []
    for df, own, n in zip(dfs, places, counts):
        if not own:
            continue
        row, k = F.col(POS), len(own)
        place = F.element_at(F.array(*(F.lit(i) for i in own)), (row % k + 1).cast("int")).cast("bigint")
        parts.append(df.withColumn(POS, F.expr(f"{POS} div {k}") * period + place))
        if n is not None:
            ends.append(n // k * period + own[n % k])
    out = _union(parts)
    return out.where(F.col(POS) < min(ends)) if ends else out
