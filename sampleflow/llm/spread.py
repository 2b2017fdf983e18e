"""Moving packed numpy arrays between Spark tasks, and tables that cut lineage.

A billion small records are cheap to exchange when each row of the DataFrame is
a bucket's share of one task: a few binary columns, one array each, stored byte
plane by byte plane so that the shuffle's compression removes constant planes.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import flat

#: Records gathered before they are split over the buckets.
GATHER = 1 << 20
#: Bytes of the batches in which texts go to Python.
BATCH_BYTES = 4 << 20


def planes(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges of equal width over 64 bits: a smaller key never has a larger bucket."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the texts that a task holds at once, in the JVM and in Python, unless the session has set its own bound."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if spark.conf.get(name).rstrip("b") == str(default):
        spark.conf.set(name, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Ragged:
    """A list of numbers for each record: ``counts`` and the numbers in order."""

    def __init__(self, counts: np.ndarray, values: np.ndarray):
        self.counts, self.values = counts, values

    def take(self, at: np.ndarray) -> Ragged:
        ends = np.cumsum(self.counts, dtype=np.int64)
        counts = self.counts[at]
        begin = np.repeat(ends[at] - counts, counts)
        within = np.arange(len(begin)) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts)
        return Ragged(counts, self.values[begin + within])

    @staticmethod
    def join(parts: list[Ragged]) -> Ragged:
        return Ragged(np.concatenate([p.counts for p in parts]), np.concatenate([p.values for p in parts]))


def take(a: np.ndarray | Ragged, at: np.ndarray) -> np.ndarray | Ragged:
    return a.take(at) if isinstance(a, Ragged) else a[at]


def rows(bucket: np.ndarray, fields: dict[str, np.ndarray | Ragged]) -> pa.RecordBatch:
    """One row for each bucket that occurs, each field packed by ``planes``; of a ragged field
    ``x`` the counts are in ``x_n``."""
    small = bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket
    order = np.argsort(small, kind="stable")
    names, begin = np.unique(bucket[order], return_index=True)
    cuts = np.append(begin, len(bucket))
    columns: dict[str, pa.Array] = {"bucket": pa.array(names, pa.int32())}

    def column(a: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.array([planes(a[i:j]) for i, j in zip(at, at[1:])], pa.binary())

    for k, a in fields.items():
        part = take(a, order)
        if isinstance(part, Ragged):
            columns[k + "_n"] = column(part.counts, cuts)
            columns[k] = column(part.values, np.append(0, np.cumsum(part.counts, dtype=np.int64))[cuts])
        else:
            columns[k] = column(part, cuts)
    return pa.RecordBatch.from_pydict(columns)


def schema(*fields: str) -> str:
    return ", ".join(["bucket int", *(f"{f} binary" for f in fields)])


class Gather:
    """Collects records until ``GATHER`` are there, then gives their packed rows."""

    def __init__(self, n: int, limit: int = GATHER):
        self.n, self.limit, self.count, self.parts = n, limit, 0, []

    def add(self, keys: np.ndarray, **fields: np.ndarray | Ragged) -> Iterator[pa.RecordBatch]:
        """``keys`` choose the bucket; only ``fields`` are sent."""
        if len(keys):
            self.parts.append((bucket_of(keys, self.n), fields))
            self.count += len(keys)
        if self.count >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            joined = {k: (Ragged.join if isinstance(a, Ragged) else np.concatenate)([f[k] for _, f in self.parts]) for k, a in self.parts[0][1].items()}
            bucket = np.concatenate([b for b, _ in self.parts])
            self.parts, self.count = [], 0
            yield rows(bucket, joined)


def unpacked(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """All records of a task, each field as one array."""
    parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, dtype=t)] for k, t in kinds.items()}
    for batch in batches:
        for k, t in kinds.items():
            parts[k] += [unplanes(x.as_py(), t) for x in batch.column(batch.schema.get_field_index(k))]
    return {k: np.concatenate(v) for k, v in parts.items()}


#: Columns of rows of several kinds: ``c0`` ... hold the fields of their kind in order.
_FIELDS = 7
KINDS = ", ".join(["bucket int, kind int", *(f"c{k} binary" for k in range(_FIELDS))])


def of_kind(kind: int, bucket: np.ndarray, *fields: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows in the columns of ``KINDS``."""
    if len(bucket):
        packed = rows(bucket, {f"c{k}": a for k, a in enumerate(fields)})
        n = packed.num_rows
        empty = pa.nulls(n, pa.binary())
        columns = [packed.column(0), pa.array(np.full(n, kind, np.int32)), *(packed.column(1 + k) if k < len(fields) else empty for k in range(_FIELDS))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", *(f"c{k}" for k in range(_FIELDS))])


def kinds(batches: Iterator[pa.RecordBatch], known: dict[int, tuple[type, ...]], pass_on: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch | dict[int, list[np.ndarray]]]:
    """The rows of the kinds in ``pass_on`` as they are; at last a dict: of each known kind its fields as
    arrays over all rows, and the bucket of each record."""
    parts: dict[int, list[list[np.ndarray]]] = {k: [[np.zeros(0, dtype=t)] for t in (*types, np.int32)] for k, types in known.items()}
    for batch in batches:
        kind = batch.column(1).to_numpy()
        go = np.flatnonzero(np.isin(kind, pass_on))
        if len(go):
            yield batch.take(pa.array(go))
        for i in np.flatnonzero(np.isin(kind, list(known))).tolist():
            types = known[int(kind[i])]
            fields = [unplanes(batch.column(2 + k)[i].as_py(), t) for k, t in enumerate(types)]
            for into, a in zip(parts[int(kind[i])], (*fields, np.full(len(fields[0]), batch.column(0)[i].as_py(), np.int32))):
                into.append(a)
    out: dict[int, list[np.ndarray]] = {}
    for k, fields in parts.items():
        out[k] = []
        while fields:  # so that a field's parts are free before the next field is joined
            out[k].append(np.concatenate(fields.pop(0)))
    flat.release()
    yield out


def exchange(df: DataFrame, n: int) -> DataFrame:
    """Each bucket's rows to the partition of its number."""
    return df.repartitionById(n, "bucket")


def per_task(df: DataFrame, f: Callable, kinds: dict[str, type], out: str) -> DataFrame:
    """``f`` turns all records of a task into RecordBatches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(unpacked(batches, kinds))
        flat.release()

    return df.mapInArrow(run, out)


def tidy(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of jobs that nothing refers to any more; it does so
    when the driver's JVM collects its garbage, which it may not need to do for hours."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode without one, a folder of this process."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        own = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="sampleflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _OWN[context.applicationId]


def table(df: DataFrame) -> Table:
    """Writes ``df`` to the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/sampleflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Table(df.sparkSession, path)


class Table:
    """A written table; ``df`` reads it, ``drop`` deletes it once nothing reads it any more.
    What is left goes when the process ends."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        _LEFT[path] = spark

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        _LEFT.pop(self.path, None)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_LEFT: dict[str, SparkSession] = {}


def _drop_left() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            Table(spark, path).drop()
        except Exception:  # the JVM has gone; the folder's owner removes what is left
            return


atexit.register(_drop_left)
