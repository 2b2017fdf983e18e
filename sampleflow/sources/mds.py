"""Folders in the MDS shard format: an index.json, and shards of fixed or length-prefixed columns."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.rows import merged, record_batch, settled, type_of

_NUMBERS = {k: np.dtype(k) for k in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64")} | {"int": np.dtype("int64")}


def _kind(encoding: str) -> T.DataType | None:
    if encoding in _NUMBERS:
        return T.DoubleType() if _NUMBERS[encoding].kind == "f" else T.LongType()
    return {"str": T.StringType(), "bytes": T.BinaryType()}.get(encoding)


def _value(encoding: str, raw: bytes) -> Any:
    if encoding in _NUMBERS:
        return np.frombuffer(raw, _NUMBERS[encoding])[0].item()
    if encoding == "str":
        return raw.decode()
    if encoding == "bytes":
        return raw
    if encoding == "json":
        return json.loads(raw)
    raise ValueError(f"the MDS encoding {encoding} isn't supported")


def samples(data: bytes, shard: dict[str, Any]) -> Iterator[dict[str, Any]]:
    (n,) = struct.unpack_from("<I", data, 0)
    offsets = struct.unpack_from(f"<{n + 1}I", data, 4)
    for at in offsets[:-1]:
        sizes = []
        for size in shard["column_sizes"]:
            if size is None:
                sizes.append(struct.unpack_from("<I", data, at)[0])
                at += 4
            else:
                sizes.append(size)
        row = {}
        for name, encoding, size in zip(shard["column_names"], shard["column_encodings"], sizes):
            row[name] = _value(encoding, data[at : at + size])
            at += size
        yield row


def _data(folder: str, shard: dict[str, Any]) -> bytes:
    raw = Path(folder, shard["raw_data"]["basename"])
    if raw.exists():
        return raw.read_bytes()
    packed = Path(folder, shard["zip_data"]["basename"]).read_bytes()
    kind = (shard.get("compression") or "").split(":")[0]
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(packed)
    if kind == "gz":
        import gzip

        return gzip.decompress(packed)
    raise ValueError(f"the compression {kind} isn't supported")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, row, columns ...) of a folder that all workers can read; a shard is a task."""
    shards = json.loads(Path(folder, "index.json").read_text())["shards"]
    kind: T.DataType = T.StructType([])
    for s in shards:
        own = [(k, _kind(e)) for k, e in zip(s["column_names"], s["column_encodings"])]
        first = next(samples(_data(folder, s), s), {}) if any(t is None for _, t in own) else {}
        kind = merged(kind, T.StructType([T.StructField(k, t if t is not None else type_of(first.get(k))) for k, t in own]))
    schema = settled(kind)
    assert isinstance(schema, T.StructType)
    out = T.StructType([T.StructField("shard", T.LongType()), T.StructField("row", T.LongType()), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                part: list[dict[str, Any]] = []
                for i, row in enumerate(samples(_data(folder, shards[k]), shards[k])):
                    part.append({**row, "shard": k, "row": i})
                    if len(part) == 4096:
                        yield record_batch(part, out)
                        part = []
                yield record_batch(part, out)

    return spark.range(len(shards), numPartitions=max(1, len(shards))).mapInArrow(run, out)
