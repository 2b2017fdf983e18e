"""Order: enumerate, take, stride, batch, shuffle. All but the rows' arithmetic needs dense positions."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..order import POS, data_columns, in_order, ordered_scan
from .rows import Row, as_schema, nothing_lost, record_batch, schema_of, with_pos


def numbered(df: DataFrame, column: str = "step") -> DataFrame:
    return df.withColumn(column, F.col(POS)) if column else df


def take(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col(POS) < n)


def stride(df: DataFrame, interval: int, offset: int) -> DataFrame:
    if not 0 <= offset < interval:
        raise ValueError("the offset must be at least 0 and less than the interval")
    return df.where(F.col(POS) % interval == offset).withColumn(POS, F.expr(f"{POS} div {interval}"))


def _collated(name: str, kind: T.DataType) -> F.Column:
    values = in_order(F.col(name))
    if not isinstance(kind, T.ArrayType):
        return values.alias(name)
    sizes = F.array_distinct(F.transform(values, lambda x: F.size(x)))
    unlike = F.raise_error(F.lit(f"{name}: arrays of unlike length can't be collated")).cast(T.ArrayType(kind))
    return F.when(F.size(sizes) <= 1, values).otherwise(unlike).alias(name)


def batch(df: DataFrame, size: int, collate: Callable[[list[Row]], Row] | None = None, drop_last: bool = False, schema: str | T.StructType | None = None) -> DataFrame:
    """Rows in groups of ``size``; each column becomes an array, or ``collate`` makes the row of the group."""
    if size < 1:
        raise ValueError("a batch has at least 1 row")
    grouped = df.withColumn("__batch", F.expr(f"{POS} div {size}"))
    if collate is None:
        kinds = {f.name: f.dataType for f in df.schema}
        out = grouped.groupBy("__batch").agg(F.count(F.lit(1)).alias("__n"), *(_collated(c, kinds[c]) for c in data_columns(df)))
        if drop_last:
            out = out.where(F.col("__n") == size)
        return out.drop("__n").withColumnRenamed("__batch", POS)
    probed = schema is None
    if schema is None:
        first = [r.asDict(recursive=True) for r in df.where(F.col(POS) < size).orderBy(POS).select(*data_columns(df)).collect()]
        schema = schema_of([collate(first)]) if first else "empty string"
    out_schema = with_pos(as_schema(schema))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r[POS])
        number = rows[0].pop("__batch")
        for r in rows:
            r.pop("__batch", None)
            r.pop(POS)
        found = [] if drop_last and len(rows) < size else [{**collate(rows), POS: number}]
        if probed:
            found = [nothing_lost(r, out_schema) for r in found]
        return pa.Table.from_batches([record_batch(found, out_schema)])

    return grouped.groupBy("__batch").applyInArrow(run, out_schema)


def buffer_order(n: int, size: int, seed: int) -> Iterator[int]:
    """Where a shuffle buffer takes its rows from: it holds ``size`` rows, gives a random one, whose place
    the last one gets, and reads the next."""
    chooser, held = random.Random(seed), list(range(min(n, size)))
    read = len(held)
    while held:
        k = chooser.randrange(len(held))
        held[k], held[-1] = held[-1], held[k]
        yield held.pop()
        if read < n:
            held.append(read)
            read += 1


def numbers(values: Iterator[Any], name: str, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(__pos, name) for an iterator of numbers."""
    part: list[int] = []
    start = 0
    for v in values:
        part.append(v)
        if len(part) == size:
            yield pa.RecordBatch.from_pydict({POS: pa.array(range(start, start + size), pa.int64()), name: pa.array(part, pa.int64())})
            start, part = start + size, []
    if part:
        yield pa.RecordBatch.from_pydict({POS: pa.array(range(start, start + len(part)), pa.int64()), name: pa.array(part, pa.int64())})


def shuffle(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """A bounded shuffle buffer. Its order follows from the number of rows alone, so one task makes
    (new, old) positions, without data, and the rows are joined to it."""
    if size < 1:
        raise ValueError("the buffer holds at least 1 row")
    if size == 1:
        return df

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.column(0)[0].as_py() for b in batches if b.num_rows)
        yield from numbers(buffer_order(n, size, seed), "__old")

    moves = df.agg(F.count(F.lit(1)).alias("n")).coalesce(1).mapInArrow(plan, f"{POS} bigint, __old bigint")
    return df.withColumnRenamed(POS, "__old").join(moves, "__old").drop("__old").select(*df.columns)


def permuted(df: DataFrame, epochs: int, seed: int, count: int) -> DataFrame:
    """Epochs of full permutations, each a shuffle of the one before."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass

        def order() -> Iterator[int]:
            chooser, now = random.Random(seed), list(range(count))
            for _ in range(epochs):
                chooser.shuffle(now)
                yield from now

        yield from numbers(order(), "__old")

    moves = df.sparkSession.range(1).coalesce(1).mapInArrow(plan, f"{POS} bigint, __old bigint")
    return df.withColumnRenamed(POS, "__old").join(moves, "__old").drop("__old").select(*df.columns)


def repeated(df: DataFrame, epochs: int, count: int) -> DataFrame:
    copies = df.sparkSession.range(epochs).withColumnRenamed("id", "__epoch")
    return df.crossJoin(F.broadcast(copies)).withColumn(POS, F.col("__epoch") * count + F.col(POS)).drop("__epoch")  # one number an epoch


__all__ = ["batch", "buffer_order", "numbered", "ordered_scan", "permuted", "repeated", "shuffle", "stride", "take"]
