"""Order as a column.

A dataset is a DataFrame with ``__pos``, a bigint that orders its rows; it is dense
when it runs 0, 1, 2 ... without gaps. Positions come from row identity and counts,
never from the order in which tasks happen to run, so a retried task gives the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

POS = "__pos"
#: Rows of a block of the two-level scans.
BLOCK = 1 << 16


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("start a SparkSession first")
    return found


def _block_offsets(sums: DataFrame, value: str) -> DataFrame:
    """The exclusive prefix sum over blocks; one row a block, so a table smaller than its data by BLOCK."""
    before = F.sum(value).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("__block", F.coalesce(before, F.lit(0)).cast("bigint").alias("__before"))


def dense(df: DataFrame, *ties: str) -> DataFrame:
    """``df`` with its positions closed up to 0, 1, 2 ...; equal positions are ordered by ``ties``."""
    blocked = df.withColumn("__block", F.expr(f"{POS} div {BLOCK}"))
    offsets = _block_offsets(blocked.groupBy("__block").agg(F.count(F.lit(1)).alias("n")), "n")
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(POS, *ties)) - 1
    out = blocked.withColumn("__rank", rank).join(offsets, "__block")
    return out.withColumn(POS, F.col("__rank") + F.col("__before")).drop("__block", "__rank", "__before")


def from_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Dense positions by ``keys``. An integral first key is cut into blocks of equal width, counted in
    one pass and ranked block by block; any other key is ranked in one task."""
    if not keys:
        raise ValueError("an order needs a key")
    if not isinstance(df.schema[keys[0]].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(POS, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("bigint"))
    low, high, n = df.agg(F.min(keys[0]), F.max(keys[0]), F.count(F.lit(1))).first()
    if n and low is not None and high - low + 1 == n and df.select(keys[0]).where(f"{keys[0]} is null").isEmpty() and len(keys) == 1:
        if df.groupBy(keys[0]).count().where("count > 1").isEmpty():
            return df.withColumn(POS, (F.col(keys[0]) - F.lit(low)).cast("bigint"))
    # Keys may span all of a bigint: their differences don't fit, quotients by 2 or more do, with room for the nulls' block.
    width = min(max(2, (0 if low is None else high - low) * BLOCK // max(n, 1)), 1 << 62)
    nulls = -(abs(low or 0) // width) - 2
    place = F.coalesce(F.expr(f"cast(`{keys[0]}` as bigint) div {width}L"), F.lit(nulls).cast("bigint"))
    blocked = df.withColumn("__block", place)
    offsets = _block_offsets(blocked.groupBy("__block").agg(F.count(F.lit(1)).alias("n")), "n")
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(*keys)) - 1
    return blocked.withColumn("__rank", rank).join(offsets, "__block").withColumn(POS, F.col("__rank") + F.col("__before")).drop("__block", "__rank", "__before")


def prefix_sum(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all rows before."""
    blocked = df.withColumn("__value", value).withColumn("__block", F.expr(f"{POS} div {BLOCK}"))
    offsets = _block_offsets(blocked.groupBy("__block").agg(F.sum("__value").alias("n")), "n")
    within = F.sum("__value").over(Window.partitionBy("__block").orderBy(POS).rowsBetween(Window.unboundedPreceding, -1))
    out = blocked.withColumn("__within", F.coalesce(within, F.lit(0))).join(offsets, "__block")
    return out.withColumn(name, (F.col("__within") + F.col("__before")).cast("bigint")).drop("__block", "__value", "__within", "__before")


def ordered_scan(narrow: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """One task over all rows in order: for what is sequential by nature. Give it numbers only."""
    return narrow.repartition(1).sortWithinPartitions(POS).mapInArrow(step, schema)


def in_order(value: Column) -> Column:
    """Aggregate: the values of a group as an array ordered by position."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(POS).alias("p"), value.alias("v")))), lambda x: x["v"])


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != POS]
