"""Row by row: map, filter and both at once, by expressions or Python functions."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..order import POS, data_columns

Row = dict[str, Any]


def type_of(value: Any) -> T.DataType:
    """The Spark type of a Python value."""
    if value is None:
        return T.NullType()
    for kind, out in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (bytes, T.BinaryType()), (datetime.datetime, T.TimestampType()), (datetime.date, T.DateType()), (decimal.Decimal, T.DecimalType(38, 18))):
        if isinstance(value, kind):
            return out
    if isinstance(value, Mapping):
        return T.StructType([T.StructField(str(k), type_of(v)) for k, v in value.items()])
    if hasattr(value, "tolist"):
        return type_of(value.tolist())
    if isinstance(value, (list, tuple)):
        kind: T.DataType = T.NullType()
        for v in value:
            kind = merged(kind, type_of(v))
        return T.ArrayType(kind)
    raise TypeError(f"no column type for {type(value).__name__}")


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both; text where they have nothing in common."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        have = {f.name: f.dataType for f in a}
        for f in b:
            have[f.name] = merged(have[f.name], f.dataType) if f.name in have else f.dataType
        return T.StructType([T.StructField(k, v) for k, v in have.items()])
    return T.StringType()


def settled(kind: T.DataType) -> T.DataType:
    """Without null types, which files can't hold: what was always null is text, what was always empty bigints."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(T.LongType() if isinstance(kind.elementType, T.NullType) else settled(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType)) for f in kind])
    return kind


def schema_of(rows: list[Row]) -> T.StructType:
    kind = T.StructType([])
    for r in rows:
        found = merged(kind, type_of(r))
        assert isinstance(found, T.StructType)
        kind = found
    out = settled(kind)
    assert isinstance(out, T.StructType)
    return out


def as_schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def plain(value: Any, kind: T.DataType) -> Any:
    """A Python value as Arrow takes it for a column of this type."""
    if value is None:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(kind, T.ArrayType):
        return [plain(v, kind.elementType) for v in (value if isinstance(value, (list, tuple)) else [value])]
    if isinstance(kind, T.StructType):
        return {f.name: plain(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return str(value)
    return value


def record_batch(rows: list[Row], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    columns = [pa.array([plain(r.get(f.name), f.dataType) for r in rows], type=arrow.field(f.name).type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def with_pos(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(POS, T.LongType()), *(f for f in schema if f.name != POS)])


def unknown(value: Any, kind: T.DataType, at: str = "") -> str | None:
    """The first key of a Python value, or of a dictionary within it, that its schema lacks."""
    if isinstance(kind, T.StructType) and isinstance(value, Mapping):
        fields = {f.name: f.dataType for f in kind}
        for k, v in value.items():
            found = unknown(v, fields[k], f"{at}{k}.") if k in fields else f"{at}{k}"
            if found:
                return found
    if isinstance(kind, T.ArrayType) and isinstance(value, (list, tuple)) and isinstance(kind.elementType, (T.ArrayType, T.StructType)):
        return next(filter(None, (unknown(v, kind.elementType, at) for v in value)), None)
    return None


def nothing_lost(row: Row, schema: T.StructType) -> Row:
    """The row, or an error where a probed schema would lose one of its keys."""
    lost = unknown(row, schema)
    if lost:
        raise ValueError(f"{lost} isn't among the keys of the first results: give a schema")
    return row


def probe(df: DataFrame, fn: Callable[[Row], Row | None], rows: int = 100) -> T.StructType:
    """The schema of what ``fn`` gives for the first rows; those where it gives nothing count as nothing."""
    first = [r.asDict(recursive=True) for r in df.where(F.col(POS) < rows).orderBy(POS).select(*data_columns(df)).collect()]
    return schema_of([r for r in map(fn, first) if r is not None])


def filter_map(df: DataFrame, fn: Callable[[Row], Row | None], schema: str | T.StructType | None = None) -> DataFrame:
    """fn's rows, without those for which it gives None. The schema is that of its first results unless given;
    then a key that only occurs later is an error. Keys that a given schema lacks are left out."""
    probed = schema is None
    out = with_pos(as_schema(schema) if schema is not None else probe(df, fn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                pos = row.pop(POS)
                new = fn(row)
                if new is not None:
                    row = {**new, POS: pos}
                    found.append(nothing_lost(row, out) if probed else row)
            yield record_batch(found, out)

    return df.mapInArrow(run, out)


def strict(fn: Callable[[Row], Row | None]) -> Callable[[Row], Row]:
    def run(row: Row) -> Row:
        new = fn(row)
        if new is None:
            raise ValueError("the function of parallel_map must not return None")
        return new

    return run


def map_columns(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Adds or replaces columns by expressions."""
    return df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()})


def where(df: DataFrame, keep: Column | str | Callable[[Row], Any]) -> DataFrame:
    """The rows for which an expression, or a Python function of the row, is true."""
    if isinstance(keep, (Column, str)):
        return df.where(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [bool(keep({k: v for k, v in row.items() if k != POS})) for row in batch.to_pylist()]
            yield batch.filter(pa.array(chosen, pa.bool_()))

    return df.mapInArrow(run, df.schema)
