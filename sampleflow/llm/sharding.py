"""Shards of documents that lie close in their metadata: a k-d tree over (length,
source, language, doc_id), cut until each leaf holds at most the target bytes.

All leaves of a level are cut together. A leaf's widest dimension, by its extent over
that of the whole table, is cut at the weighted median of the documents' bytes: sums
over ranges of the dimension find the range that holds it, sums over the values in
that range the median. Values up to the median go left, or those below the greatest
value if the median is that. A leaf whose documents agree in all dimensions stays
whole. What reaches the driver grows with the number of leaves being cut.

Bytes are those of the text in UTF-8. The length is log2(1 + bytes); names are
ordered by their first six bytes.

Defined cases: null and empty texts weigh 0 bytes; null names and doc_ids lie before
all others. Repeated rows go to the same shard. Extra columns are not read. An empty
table has no shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spread import table

DIMENSIONS = ("length", "source", "lang", "id")
RANGES = 256


def _place(name: str) -> Column:
    """The first six bytes of a name as a number; -1 for null."""
    code = F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(name).cast("string"), "UTF-8"), 1, 6)), 12, "0"), 16, 10)
    return F.coalesce(code.cast("double"), F.lit(-1.0))


def metadata(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("double")
    known = F.coalesce(F.col("doc_id").cast("double"), F.lit(float(-(1 << 62))))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("bytes"), F.log2(size + 1).alias("length"), _place("source").alias("source"), _place("lang").alias("lang"), known.alias("id"))


class Tree:
    """Node i is cut at cut[i] of dimension[i], its children are left[i] and left[i] + 1; a leaf has left[i] = -1."""

    def __init__(self):
        self.dimension, self.cut, self.left = [0], [0.0], [-1]

    def split(self, node: int, dimension: int, cut: float) -> None:
        self.dimension[node], self.cut[node], self.left[node] = dimension, cut, len(self.left)
        for _ in range(2):
            self.dimension.append(0)
            self.cut.append(0.0)
            self.left.append(-1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        dimension, cut, left = np.array(self.dimension), np.array(self.cut), np.array(self.left)
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            inner = left[node] >= 0
            if not inner.any():
                return node
            node = np.where(inner, left[node] + (x[rows, dimension[node]] > cut[node]), node)

    def shards(self) -> dict[int, int]:
        """Leaves from left to right."""
        out, work = {}, [0]
        while work:
            node = work.pop()
            if self.left[node] < 0:
                out[node] = len(out)
            else:
                work += [self.left[node] + 1, self.left[node]]
        return out


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(d)).to_numpy() for d in DIMENSIONS])


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("bytes")).to_numpy()


def build(rows: DataFrame, target_bytes: float) -> Tree:
    tree, d = Tree(), len(DIMENSIONS)
    whole: np.ndarray | None = None
    active = {0}
    bounds = ", ".join(f"low_{k} double, high_{k} double" for k in range(d))

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, w = _points(batch), _bytes(batch)
            nodes, which = np.unique(tree.leaves(x), return_inverse=True)
            low, high = np.full((len(nodes), d), np.inf), np.full((len(nodes), d), -np.inf)
            np.minimum.at(low, which, x)
            np.maximum.at(high, which, x)
            keep = np.isin(nodes, list(active))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(np.bincount(which, weights=w, minlength=len(nodes))[keep].astype(np.float64)), *(pa.array(a[keep, k]) for k in range(d) for a in (low, high))], names=["node", "bytes", *(f"{s}_{k}" for k in range(d) for s in ("low", "high"))])

    def weights(chosen: dict[int, tuple[int, float, float]]):
        """(node, range, value, bytes): sums over ranges of the chosen dimensions, or over values where the
        chosen range is a single one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes = np.array(sorted(chosen))
            dims = np.array([chosen[n][0] for n in nodes.tolist()])
            low, high = (np.array([chosen[n][k] for n in nodes.tolist()]) for k in (1, 2))
            for batch in batches:
                x, w = _points(batch), _bytes(batch)
                leaf = tree.leaves(x)
                at = np.minimum(np.searchsorted(nodes, leaf), len(nodes) - 1)
                own = np.flatnonzero(nodes[at] == leaf)
                at, v, w = at[own], x[own, dims[at[own]]], w[own]
                slot = np.clip(((v - low[at]) / (high[at] - low[at]) * RANGES).astype(np.int64), 0, RANGES - 1)
                keys, which = np.unique(at * RANGES + slot, return_inverse=True)
                top = np.full(len(keys), -np.inf)
                np.maximum.at(top, which, v)
                yield pa.RecordBatch.from_pydict({"node": nodes[keys // RANGES], "slot": keys % RANGES, "top": top, "bytes": np.bincount(which, weights=w, minlength=len(keys)).astype(np.float64), "n": np.bincount(which, minlength=len(keys)).astype(np.float64)})

        return run

    def values(chosen: dict[int, tuple[int, float, float, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes = np.array(sorted(chosen))
            dims, slots = (np.array([chosen[n][k] for n in nodes.tolist()]) for k in (0, 3))
            low, high = (np.array([chosen[n][k] for n in nodes.tolist()]) for k in (1, 2))
            for batch in batches:
                x, w = _points(batch), _bytes(batch)
                leaf = tree.leaves(x)
                at = np.minimum(np.searchsorted(nodes, leaf), len(nodes) - 1)
                own = np.flatnonzero(nodes[at] == leaf)
                at, v, w = at[own], x[own, dims[at[own]]], w[own]
                slot = np.clip(((v - low[at]) / (high[at] - low[at]) * RANGES).astype(np.int64), 0, RANGES - 1)
                keep = slot == slots[at]
                yield pa.RecordBatch.from_pydict({"node": nodes[at[keep]], "value": v[keep], "bytes": w[keep]})

        return run

    while active:
        found = rows.mapInArrow(extents, f"node bigint, bytes double, {bounds}").groupBy("node").agg(F.sum("bytes").alias("bytes"), *(f(f"{s}_{k}").alias(f"{s}_{k}") for k in range(d) for s, f in (("low", F.min), ("high", F.max)))).collect()
        chosen: dict[int, tuple[int, float, float]] = {}
        half: dict[int, float] = {}
        for r in found:
            extent = np.array([r[f"high_{k}"] - r[f"low_{k}"] for k in range(d)])
            if whole is None:
                whole = np.where(extent > 0, extent, 1.0)
            if r.bytes > target_bytes and extent.max() > 0:
                k = int((extent / whole).argmax())
                chosen[r.node] = (k, r[f"low_{k}"], r[f"high_{k}"])
                half[r.node] = r.bytes / 2
        if not chosen:
            break
        spark = rows.sparkSession
        halves = F.broadcast(spark.createDataFrame([(n, h) for n, h in half.items()], "node bigint, half double"))  # a row a leaf being cut
        by = Window.partitionBy("node").orderBy("slot")
        summed = rows.mapInArrow(weights(chosen), "node bigint, slot bigint, top double, bytes double, n double").groupBy("node", "slot").agg(F.sum("bytes").alias("bytes"), F.max("top").alias("top"))
        ran = summed.withColumn("upto", F.sum("bytes").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        picked = ran.join(halves, "node").where("upto >= half").groupBy("node").agg(F.min(F.struct("slot", (F.col("upto") - F.col("bytes")).alias("before"))).alias("m")).select("node", "m.*").collect()
        inside = {r.node: (*chosen[r.node], r.slot) for r in picked}
        before = F.broadcast(spark.createDataFrame([(r.node, half[r.node] - r.before) for r in picked], "node bigint, rest double"))
        by = Window.partitionBy("node").orderBy("value")
        summed = rows.mapInArrow(values(inside), "node bigint, value double, bytes double").groupBy("node", "value").agg(F.sum("bytes").alias("bytes"))
        ran = summed.withColumn("upto", F.sum("bytes").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("below", F.lag("value").over(by))
        medians = ran.join(before, "node").where("upto >= rest").groupBy("node").agg(F.min(F.struct("value", "below")).alias("m")).select("node", "m.*").collect()
        top = {r.node: r for r in medians}
        need = [n for n, r in top.items() if r.value >= chosen[n][2] and r.below is None]
        lower: dict[int, float] = {}
        if need:  # the greatest value before the range that holds the median
            slots = {n: inside[n][3] for n in need}
            lows = F.broadcast(spark.createDataFrame(list(slots.items()), "node bigint, at bigint"))
            part = rows.mapInArrow(weights({n: chosen[n] for n in need}), "node bigint, slot bigint, top double, bytes double, n double")
            lower = {r.node: r.top for r in part.join(lows, "node").where("slot < at").groupBy("node").agg(F.max("top").alias("top")).collect()}
        active = set()
        for n in sorted(chosen):
            cut = top[n].value
            if cut >= chosen[n][2]:
                cut = lower[n] if top[n].below is None else top[n].below
            tree.split(n, chosen[n][0], cut)
            active |= {tree.left[n], tree.left[n] + 1}
    return tree


def shards(docs: DataFrame, target_bytes: float = 64 << 20) -> DataFrame:
    """(doc_id, bytes, shard) of each document."""
    if target_bytes <= 0:
        raise ValueError("target_bytes must be over 0")
    rows = table(metadata(docs)).df
    tree = build(rows, target_bytes)
    number = tree.shards()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.full(len(tree.left), -1, dtype=np.int32)
        names[list(number)] = list(number.values())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_bytes(batch).astype(np.int64)), pa.array(names[tree.leaves(_points(batch))])], names=["doc_id", "bytes", "shard"])

    return rows.mapInArrow(run, "doc_id bigint, bytes bigint, shard int")
