"""Token arrays: normalisation, boundary tokens, padding and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def as_tokens(df: DataFrame, name: str) -> Column:
    """array<bigint> of a column that holds an integer, an array of integers, or an array that holds one
    such array; null becomes empty. Other types are refused when the plan is made."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.NullType):
        return F.array().cast("array<bigint>")
    if isinstance(kind, _INTEGRAL):
        return F.when(value.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(value.cast("bigint")))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, _INTEGRAL):
            value = F.when(F.size(value) == 1, value[0]).when(value.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit(f"{name}: a token array must have one dimension")).cast("array<bigint>"))
            inner = inner.elementType
        if isinstance(inner, _INTEGRAL) or isinstance(inner, T.NullType):
            return F.coalesce(value.cast("array<bigint>"), F.array().cast("array<bigint>"))
    raise ValueError(f"{name}: {kind.simpleString()} isn't an array of integers")


def append_ends(tokens: Column, bos: int | None, eos: int | None) -> Column:
    parts = [F.array(F.lit(bos).cast("bigint"))] * (bos is not None) + [tokens] + [F.array(F.lit(eos).cast("bigint"))] * (eos is not None)
    return F.concat(*parts) if len(parts) > 1 else tokens


def padded(tokens: Column, value: int, length: int, name: str = "tokens") -> Column:
    """Filled up to ``length`` on the right; longer arrays are an error."""
    full = F.concat(tokens, F.array_repeat(F.lit(value).cast("bigint"), F.lit(length) - F.size(tokens)))
    too_long = F.raise_error(F.concat(F.lit(f"{name}: "), F.size(tokens).cast("string"), F.lit(f" tokens don't fit in {length}")))
    return F.when(F.size(tokens) <= length, full).otherwise(too_long.cast("array<bigint>"))


def checked_sizes(columns: dict[str, Column]) -> Column:
    """The common size of a row's token arrays; unlike sizes are an error."""
    first, *rest = columns.values()
    size = F.size(first)
    for other in rest:
        size = F.when(F.size(other) == F.size(first), size).otherwise(F.raise_error(F.lit("token columns must be of equal length")).cast("int"))
    return size


def chunks_of(tokens: Column, length: int, keep_rest: bool) -> Column:
    """array<array<bigint>>: consecutive slices of ``length``; what is left over at the end is kept or dropped."""
    n = F.ceil(F.size(tokens) / length) if keep_rest else F.floor(F.size(tokens) / length)
    n = n.cast("int")
    empty = F.array().cast("array<array<bigint>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(tokens, k * length + 1, F.lit(length)))).otherwise(empty)


def split_words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def hex_bytes(text: Column) -> Column:
    """The bytes of a text in UTF-8 as token ids, without a tokenizer. In Latin-1 each byte is a character,
    so the text is split once; the function of a byte must not mention the text, or it is encoded for every byte."""
    bytes_ = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    each = F.transform(bytes_, lambda c: F.ascii(c).cast("bigint"))
    return F.when(F.length(text) > 0, each).otherwise(F.array().cast("array<bigint>"))
