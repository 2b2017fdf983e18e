"""Sharded JSONL and CBOR files, merged in a fixed order.

A shard is read by one task; its rows are (shard, row, payload). The merge keeps
``n_active_shards`` shards open and takes a row from each in turn; when one ends the
next shard joins at the end of the turn, and those of the next epoch wait until all
of this one are used up. The order depends on the shards' numbers of rows alone, so it is planned on
the driver as segments, a few a shard, and a row's position follows from its segment.
"""

from __future__ import annotations

import base64
import bz2
import datetime
import gzip
import http.client
import io
import itertools
import json
import lzma
import math
import os
import random
import re
import time
import urllib.error
import zlib
from collections import deque
from collections.abc import Iterator, Sequence
from typing import Any, BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.rows import as_schema, merged, settled, type_of
from ..order import POS
from . import cbor

#: How often a shard is opened without a row gained before its reading fails, and the seconds between: each wait
#: is twice the one before, up to the greatest.
TRIES, FIRST_WAIT, GREATEST_WAIT = 10, 1.0, 60.0
#: Bad JSON lines in a row that end the reading of a shard.
BAD_LINES = 10
_RANGE = re.compile(r"^(-?\d+|[A-Za-z])\.\.(-?\d+|[A-Za-z])(?:\.\.(-?\d+))?$")


def expand_braces(pattern: str) -> list[str]:
    """Every string of a pattern with {a,b} and {00..99} in it, in order; other braces stay."""
    depth, begin = 0, -1
    for i, ch in enumerate(pattern):
        if ch == "{":
            if depth == 0:
                begin = i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                options = _options(pattern[begin + 1 : i])
                if options is None:
                    return [pattern[: i + 1] + rest for rest in expand_braces(pattern[i + 1 :])]
                rests = expand_braces(pattern[i + 1 :])
                return [pattern[:begin] + o + rest for o in options for rest in rests]
    return [pattern]


def _options(inside: str) -> list[str] | None:
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(inside):
        depth += (ch == "{") - (ch == "}")
        if ch == "," and depth == 0:
            parts.append(inside[last:i])
            last = i + 1
    if parts:
        return [o for p in (*parts, inside[last:]) for o in expand_braces(p)]
    found = _RANGE.match(inside)
    if not found:
        inner = expand_braces(inside)
        return ["{" + o + "}" for o in inner] if len(inner) > 1 else None
    a, b, step = found.groups()
    by = abs(int(step or 1)) or 1
    if a.lstrip("-").isdigit() != b.lstrip("-").isdigit():
        return None
    if a.lstrip("-").isdigit():
        padded = any(len(x.lstrip("-")) > 1 and x.lstrip("-").startswith("0") for x in (a, b))
        width = max(len(a), len(b)) if padded else 0
        low, high = int(a), int(b)
        return [f"{n:0{width}d}" for n in range(low, high + (1 if low <= high else -1), by if low <= high else -by)]
    low, high = ord(a), ord(b)
    return [chr(n) for n in range(low, high + (1 if low <= high else -1), by if low <= high else -by)]


def urls_of(urls: str | Sequence[str]) -> list[str]:
    out = [u for pattern in ([urls] if isinstance(urls, str) else urls) for u in expand_braces(str(pattern))]
    if not out:
        raise ValueError("there are no URLs")
    return out


def format_of(url: str, declared: str = "auto") -> str:
    """jsonl or cbor, by the suffix unless declared; a suffix of compression doesn't count."""
    if declared.lower() != "auto":
        if declared.lower() not in ("jsonl", "cbor"):
            raise ValueError(f"unknown format {declared}")
        return declared.lower()
    path = re.sub(r"\.(gz|bz2|xz|zst)$", "", url.lower())
    for kind in ("jsonl", "cbor"):
        if path.endswith("." + kind):
            return kind
    raise ValueError(f"no format is known for {url}")


def decompressed(f: BinaryIO, url: str) -> BinaryIO:
    lower = url.lower()
    if lower.endswith(".gz"):
        return gzip.open(f)  # type: ignore[return-value]
    if lower.endswith(".bz2"):
        return bz2.open(f)  # type: ignore[return-value]
    if lower.endswith(".xz"):
        return lzma.open(f)  # type: ignore[return-value]
    if lower.endswith(".zst"):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True))  # type: ignore[arg-type]
    return f


def jsonl_rows(f: BinaryIO) -> Iterator[dict[str, Any]]:
    """The objects of the lines; blank lines and lines that aren't JSON objects are skipped, but BAD_LINES bad ones in a row are an error."""
    bad = 0
    for line in f:
        text = line.strip()
        if not text:
            continue
        try:
            row = json.loads(text)
        except ValueError:
            row = None
        if not isinstance(row, dict):
            bad += 1
            if bad == BAD_LINES:
                raise ValueError(f"{BAD_LINES} bad lines in a row")
            continue
        bad = 0
        yield row


def cbor_rows(f: BinaryIO) -> Iterator[dict[str, Any]]:
    for row in cbor.items(f):
        if not isinstance(row, dict):
            raise ValueError("a CBOR item isn't a map")
        yield {str(k): v for k, v in row.items()}


_LAST_OPEN: dict[str, float] = {}


def wait_turn(url: str) -> None:
    """Keeps a gap between openings of one scheme in a worker: 0 s for files, else 1 s, or what
    SAMPLEFLOW_OPEN_DELAY_<SCHEME> says."""
    scheme = urlsplit(url).scheme or "file"
    gap = float(os.environ.get(f"SAMPLEFLOW_OPEN_DELAY_{scheme.upper()}", 0 if scheme == "file" else 1))
    wait = _LAST_OPEN.get(scheme, -math.inf) + gap - time.monotonic()
    if wait > 0:
        time.sleep(wait)
    _LAST_OPEN[scheme] = time.monotonic()


class _Whole(io.RawIOBase):
    """An HTTP body that ends early is an error, not an end."""

    def __init__(self, response: http.client.HTTPResponse):
        self.response = response

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: Any) -> int:
        n = self.response.readinto(buffer)
        if not n and len(buffer) and self.response.length:
            raise ConnectionError(f"{self.response.length} bytes of the body are missing")
        return n

    def close(self) -> None:
        self.response.close()
        super().close()


def opened(url: str) -> BinaryIO:
    wait_turn(url)
    scheme = urlsplit(url).scheme
    if scheme in ("http", "https"):
        import urllib.request

        return decompressed(io.BufferedReader(_Whole(urllib.request.urlopen(url))), url)
    return decompressed(open(url[7:] if url.startswith("file://") else url, "rb"), url)


def rows_of(f: BinaryIO, kind: str) -> Iterator[dict[str, Any]]:
    return jsonl_rows(f) if kind == "jsonl" else cbor_rows(f)


def _passing(error: Exception) -> bool:
    """Whether another try may go better: not for what isn't there, isn't allowed or doesn't parse."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code in (408, 429) or error.code >= 500
    if isinstance(error, (FileNotFoundError, PermissionError, IsADirectoryError, NotADirectoryError)):
        return False
    return isinstance(error, (OSError, EOFError, http.client.HTTPException, zlib.error, lzma.LZMAError))


def steady_rows(url: str, kind: str) -> Iterator[dict[str, Any]]:
    """A shard's rows. Where reading breaks off it is opened again and the rows already given are skipped."""
    given, failed, wait = 0, 0, FIRST_WAIT
    while True:
        try:
            with opened(url) as f:
                for row in itertools.islice(rows_of(f, kind), given, None):
                    given, failed, wait = given + 1, 0, FIRST_WAIT
                    yield row
            return
        except Exception as error:
            failed += 1
            if failed >= TRIES or not _passing(error):
                raise
            time.sleep(wait)
            wait = min(2 * wait, GREATEST_WAIT)


def as_json(value: Any) -> Any:
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    raise TypeError(f"no JSON form for {type(value).__name__}")


def _payloads(shard: int, rows: Iterator[dict[str, Any]], size: int = 4096) -> Iterator[pa.RecordBatch]:
    part: list[tuple[int, str, str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(part), pa.int32()), "row": pa.array([p[0] for p in part], pa.int64()), "payload": pa.array([p[1] for p in part], pa.string()), "kind": pa.array([p[2] for p in part], pa.string())})

    for i, row in enumerate(rows):
        part.append((i, json.dumps(row, default=as_json), type_of(row).json()))
        if len(part) == size:
            yield batch()
            part = []
    yield batch()


PAYLOAD = "shard int, row bigint, payload string, kind string"


class _Shard(InputPartition):
    def __init__(self, number: int, url: str, kind: str):
        self.number, self.url, self.kind = number, url, kind


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls, self.declared = json.loads(options["urls"]), options.get("declared", "auto")

    def partitions(self) -> list[InputPartition]:
        return [_Shard(k, u, format_of(u, self.declared)) for k, u in enumerate(self.urls)]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        yield from _payloads(partition.number, steady_rows(partition.url, partition.kind))


class ShardSource(DataSource):
    """spark.read.format("sampleflow_shards"): options urls (a JSON list) and declared (the format)."""

    @classmethod
    def name(cls) -> str:
        return "sampleflow_shards"

    def schema(self) -> str:
        return PAYLOAD

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def payloads(spark: SparkSession, urls: list[str], declared: str = "auto") -> DataFrame:
    """(shard, row, payload, kind) of all shards. Local files and HTTP are read by the workers, other schemes by
    Hadoop's file systems, a file a row."""
    kinds = [format_of(u, declared) for u in urls]
    if all(urlsplit(u).scheme in ("", "file", "http", "https") for u in urls):
        spark.dataSource.register(ShardSource)
        return spark.read.format("sampleflow_shards").option("urls", json.dumps(urls)).option("declared", declared).load()
    numbers = {u: (k, kind) for k, (u, kind) in enumerate(zip(urls, kinds))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                number, kind = numbers[path]
                yield from _payloads(number, rows_of(decompressed(io.BytesIO(content), path), kind))

    return spark.read.format("binaryFile").load(urls).select("path", "content").mapInArrow(run, PAYLOAD)


def schema_of_payloads(rows: DataFrame) -> T.StructType:
    """The merged schema of all rows; the distinct kinds of rows are what reaches the driver."""
    kind: T.DataType = T.StructType([])
    for r in sorted(rows.select("kind").distinct().collect()):
        kind = merged(kind, T.StructType.fromJson(json.loads(r.kind)))
    out = settled(kind)
    assert isinstance(out, T.StructType)
    return out


def rows_schema(schema: str | T.StructType) -> T.StructType:
    return as_schema(schema)


def typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The payload's columns; bytes, which travel as base64 text, are bytes again in top-level columns."""
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in schema])
    parsed = rows.withColumn("__row", F.from_json("payload", text, {"mode": "FAILFAST", "allowNonNumericNumbers": "true"}))
    columns = [F.unbase64(F.col("__row")[f.name]).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col("__row")[f.name].alias(f.name) for f in schema]
    return parsed.select(*(c for c in rows.columns if c not in ("payload", "kind")), *columns)


def epoch_orders(n: int, epochs: int, shuffle: bool, seed: int) -> list[list[int]]:
    """The shards of each epoch in order; a shuffled epoch shuffles the order of the one before."""
    chooser, now, out = random.Random(seed), list(range(n)), []
    for _ in range(epochs):
        if shuffle:
            chooser.shuffle(now)
        out.append(list(now))
    return out


def segments(counts: Sequence[int], orders: list[list[int]], n_active: int) -> list[tuple[int, int, int, int, int]]:
    """(shard, first row, end row, position of the first, step): rows of a shard in the merged order."""
    out, pos = [], 0
    width = min(n_active, len(counts))
    for order in orders:
        waiting: deque[int] = deque(order)
        active: deque[list[int]] = deque()  # shard, next row, rows left
        while True:
            while len(active) < width and waiting:
                s = waiting.popleft()
                active.append([s, 0, counts[s]])
            if not active:
                break
            rounds = min(left for _, _, left in active)
            if rounds:
                k = len(active)
                for j, a in enumerate(active):
                    out.append((a[0], a[1], a[1] + rounds, pos + j, k))
                    a[1] += rounds
                    a[2] -= rounds
                pos += rounds * k
            elif active[0][2]:
                a = active.popleft()
                out.append((a[0], a[1], a[1] + 1, pos, 1))
                a[1] += 1
                a[2] -= 1
                pos += 1
                active.append(a)
            else:
                active.popleft()
    return out


def merged_rows(rows: DataFrame, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Positions by the plan, which is a few numbers a shard, and grows with shards, not rows."""
    spark = rows.sparkSession
    table = spark.createDataFrame(plan, "__shard int, __from bigint, __to bigint, __at bigint, __step bigint")
    joined = rows.join(F.broadcast(table), (F.col("shard") == F.col("__shard")) & (F.col("row") >= F.col("__from")) & (F.col("row") < F.col("__to")))
    return joined.withColumn(POS, F.col("__at") + (F.col("row") - F.col("__from")) * F.col("__step")).drop("__shard", "__from", "__to", "__at", "__step", "shard", "row")
