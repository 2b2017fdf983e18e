"""Token sequences: boundary tokens, padding, chunks within and across rows, packing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import append_ends, as_tokens, checked_sizes, chunks_of, padded
from ..order import POS, dense, ordered_scan, prefix_sum


def add_ends(df: DataFrame, bos: int | None, eos: int | None, column: str = "input_ids") -> DataFrame:
    return df.withColumn(column, append_ends(as_tokens(df, column), bos, eos))


def pad(df: DataFrame, values: Mapping[str, int], length: int) -> DataFrame:
    _at_least_one(length)
    for c in values:
        if c not in df.columns:
            raise ValueError(f"there is no column {c}")
    return df.withColumns({c: padded(as_tokens(df, c), v, length, c) for c, v in values.items()})


def _at_least_one(length: int) -> None:
    if length < 1:
        raise ValueError("a chunk has at least 1 token")


def _targets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Position, the token columns, and their common size as __n."""
    if not columns:
        raise ValueError("name at least one token column")
    tokens = df.select(POS, *(as_tokens(df, c).alias(c) for c in columns))
    return tokens.withColumn("__n", checked_sizes({c: F.col(c) for c in columns}))


def chunk(df: DataFrame, length: int, columns: Sequence[str] = ("input_ids",), drop_remainder: bool = True) -> DataFrame:
    """Each row's tokens in pieces of ``length``; positions are dense again."""
    _at_least_one(length)
    cut = _targets(df, columns).where("__n >= 0")
    zipped = cut.select(POS, F.posexplode(F.arrays_zip(*(chunks_of(F.col(c), length, not drop_remainder).alias(c) for c in columns))).alias("__k", "__c"))
    return dense(zipped.select(POS, "__k", *(F.col("__c")[c].alias(c) for c in columns)), "__k").drop("__k")


def concat_chunk(df: DataFrame, length: int, columns: Sequence[str] = ("input_ids",)) -> DataFrame:
    """All rows' tokens as one sequence in pieces of ``length``, without the rest at the end. A row's
    place in the sequence is a prefix sum; it is cut where pieces end, not at every token."""
    _at_least_one(length)
    placed = prefix_sum(_targets(df, columns), F.col("__n"), "__s").where("__n > 0")
    last = f"(__s + __n - 1) div {length}"
    pieces = placed.withColumn("__chunk", F.explode(F.sequence(F.expr(f"__s div {length}"), F.expr(last))))
    begin = F.greatest(F.col("__chunk") * length - F.col("__s"), F.lit(0)).cast("int")
    size = (F.least((F.col("__chunk") + 1) * length, F.col("__s") + F.col("__n")) - F.greatest(F.col("__chunk") * length, F.col("__s"))).cast("int")
    pieces = pieces.select(POS, "__chunk", *(F.slice(c, begin + 1, size).alias(c) for c in columns))
    joined = pieces.groupBy("__chunk").agg(F.array_sort(F.collect_list(F.struct(POS, *columns))).alias("__p"))
    out = joined.select(F.col("__chunk").alias(POS), *(F.flatten(F.col("__p").getField(c)).alias(c) for c in columns))
    return out.where(F.size(columns[0]) == length)


def packs(lengths: Iterator[tuple[int, int]], capacity: int, discard_long: bool) -> Iterator[tuple[int, int]]:
    """(position, pack) of each row in a next-fit packing: a row that doesn't fit closes the pack, be it empty."""
    pack = used = 0
    for pos, n in lengths:
        if discard_long and n > capacity:
            continue
        if used + n > capacity:
            pack, used = pack + 1, 0
        used += n
        yield pos, pack


def pack_chunk(df: DataFrame, length: int, columns: Sequence[str] = ("input_ids",), discard_long_samples: bool = False, whole: bool = True) -> DataFrame:
    """Whole rows packed in order into sequences of at most ``length``; a longer row is cut, or left out.
    Which pack a row is in follows from lengths alone, in one task; the tokens are grouped by it.
    whole: the rows are all there are; otherwise the last pack may go on, and is left out."""
    _at_least_one(length)
    rows = _targets(df, columns)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lengths() -> Iterator[tuple[int, int]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())

        part: list[tuple[int, int]] = []
        for x in packs(lengths(), length, discard_long_samples):
            part.append(x)
            if len(part) == 1 << 16:
                yield _plan(part)
                part = []
        yield _plan(part)

    where = ordered_scan(rows.select(POS, "__n"), plan, f"{POS} bigint, __pack bigint")
    joined = rows.join(where, POS).groupBy("__pack").agg(F.array_sort(F.collect_list(F.struct(POS, *columns))).alias("__p"))
    packed = joined.select("__pack", *(F.slice(F.flatten(F.col("__p").getField(c)), 1, length).alias(c) for c in columns))
    # A first row that is too long leaves pack 0 empty, and a last pack of empty rows isn't given.
    last = where.agg(F.max("__pack").alias("last"))
    numbers = last.where("last is not null").select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("__pack"), "last")
    full = numbers.join(packed, "__pack", "left")
    empty = F.array().cast("array<bigint>")
    out = full.select(F.col("__pack").alias(POS), "last", *(F.coalesce(c, empty).alias(c) for c in columns))
    return out.where((F.col(POS) < F.col("last")) | (F.size(columns[0]) > 0) if whole else F.col(POS) < F.col("last")).drop("last")


def _plan(part: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({POS: pa.array([x[0] for x in part], pa.int64()), "__pack": pa.array([x[1] for x in part], pa.int64())})
