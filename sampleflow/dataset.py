"""Datasets: ordered rows, declared lazily, compiled to a DataFrame with ``__pos``.

A dataset knows how to make the rows of its first ``limit`` positions, so sources
without an end are read as far as what follows needs: ``take(n)`` asks a shuffle
buffer of B for n rows, and that asks its source for n + B - 1. After a filter or a
cut into chunks the need depends on the data; the source is then read twice as far
until it is enough. A checkpoint is a position and the name of the plan; it never
changes, and resuming is a filter on positions.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import types
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import combine, ordering, rows, tokens
from .order import POS, data_columns, dense, from_keys, session
from .sources import mds, shards
from .tokenizers import Behaviour, ends_to_add

Build = Callable[[int | None], DataFrame]
Row = dict[str, Any]


def told(x: Any, depth: int = 6) -> str:
    """What tells a function, an expression or a tokenizer from others, alike in every process: code with its
    constants and what it closes over, attributes, and elements; not what a global name stands for."""
    if x is None or isinstance(x, (bool, int, float, complex, str, bytes, Column)):
        return f"{type(x).__name__}:{x!r}" if not isinstance(x, Column) else str(x)
    name = f"{type(x).__module__}.{getattr(x, '__qualname__', type(x).__qualname__)}"
    if depth == 0:
        return name
    inner: list[Any]
    if isinstance(x, Mapping):
        return name + "{" + ",".join(sorted(f"{told(k, depth - 1)}={told(v, depth - 1)}" for k, v in x.items())) + "}"
    if isinstance(x, (set, frozenset)):
        return name + "{" + ",".join(sorted(told(v, depth - 1) for v in x)) + "}"
    if isinstance(x, (list, tuple)):
        inner = list(x)
    elif isinstance(x, types.CodeType):
        inner = [x.co_code, x.co_names, x.co_varnames, x.co_consts]
    elif isinstance(x, types.FunctionType):
        inner = [x.__code__, x.__defaults__, x.__kwdefaults__, [_content(c) for c in x.__closure__ or ()]]
    elif isinstance(x, types.MethodType):
        inner = [x.__func__, x.__self__]
    elif isinstance(x, functools.partial):
        inner = [x.func, x.args, x.keywords]
    elif hasattr(x, "tobytes"):
        inner = [str(getattr(x, "dtype", "")), str(getattr(x, "shape", "")), x.tobytes()]
    elif isinstance(x, type) or not hasattr(x, "__dict__"):
        inner = []
    else:
        inner = [{k: v for k, v in vars(x).items() if not callable(v)}]
    return name + "(" + ",".join(told(v, depth - 1) for v in inner) + ")"


def _content(cell: types.CellType) -> Any:
    try:
        return cell.cell_contents
    except ValueError:  # not yet assigned
        return None


class Dataset:
    def __init__(self, build: Build, name: str, finite: bool = True):
        self._build, self.name, self.finite = build, name, finite

    # What comes out

    def to_df(self, limit: int | None = None) -> DataFrame:
        """The rows with their dense positions; without an end, those of the first ``limit``."""
        if limit is None and not self.finite:
            raise ValueError("the dataset has no end: take some rows, or give a limit")
        return self._build(limit) if limit is None else self._build(limit).where(F.col(POS) < limit)

    def state(self, offset: int) -> dict[str, Any]:
        """A checkpoint after ``offset`` rows."""
        return {"version": 1, "plan": hashlib.sha256(self.name.encode()).hexdigest(), "offset": offset}

    def iterate(self, state: Mapping[str, Any] | None = None, window: int = 1024) -> Cursor:
        if state is not None and state["plan"] != self.state(0)["plan"]:
            raise ValueError("the state is of another dataset")
        return Cursor(self, int(state["offset"]) if state else 0, window)

    def __iter__(self) -> Iterator[Row]:
        return self.iterate()

    # Row by row

    def _each(self, f: Callable[[DataFrame], DataFrame], name: str) -> Dataset:
        return Dataset(lambda limit: f(self._build(limit)), f"{name}({self.name})", self.finite)

    def _some(self, f: Callable[[DataFrame, bool], DataFrame], name: str) -> Dataset:
        """f gives fewer or more rows than it takes, by what they hold, at dense positions; its second
        argument says whether the rows are all there are."""

        def build(limit: int | None) -> DataFrame:
            if self.finite or limit is None:
                return f(self._build(None), True)
            need = max(1, 2 * limit)
            while True:
                found = f(self._build(need).where(F.col(POS) < need), False)
                if found.where(F.col(POS) < limit).count() >= limit:
                    return found
                need *= 2

        return Dataset(build, f"{name}({self.name})", self.finite)

    def map(self, fn: Callable[[Row], Row | None] | Mapping[str, Column | str], schema: str | T.StructType | None = None) -> Dataset:
        """Column expressions, or a Python function of the row; rows for which that gives None go."""
        if isinstance(fn, Mapping):
            return self._each(lambda df: rows.map_columns(df, fn), f"map[{told(fn)}]")
        return self.filter_map(fn, schema)

    def filter_map(self, fn: Callable[[Row], Row | None], schema: str | T.StructType | None = None) -> Dataset:
        return self._some(lambda df, _: dense(rows.filter_map(df, fn, schema)), f"filter_map[{told(fn)}]")

    def filter(self, keep: Column | str | Callable[[Row], Any]) -> Dataset:
        return self._some(lambda df, _: dense(rows.where(df, keep)), f"filter[{told(keep)}]")

    def parallel_map(self, fn: Callable[[Row], Row], schema: str | T.StructType | None = None, max_workers: int | None = None, prefetch_factor: int = 10, ordered: bool = True, executor_type: str = "process") -> Dataset:
        """Spark's tasks are the workers; the arguments after the schema are checked and otherwise of no effect. The result is always ordered."""
        _check_workers(max_workers, prefetch_factor, executor_type)
        strict = rows.strict(fn)
        return self._each(lambda df: rows.filter_map(df, strict, schema), f"parallel_map[{told(fn)}]")

    def parallel_filter(self, keep: Column | str | Callable[[Row], Any], max_workers: int | None = None, prefetch_factor: int = 10, ordered: bool = True, executor_type: str = "process") -> Dataset:
        _check_workers(max_workers, prefetch_factor, executor_type)
        return self.filter(keep)

    def parallel_filter_map(self, fn: Callable[[Row], Row | None], schema: str | T.StructType | None = None, max_workers: int | None = None, prefetch_factor: int = 10, ordered: bool = True, executor_type: str = "process") -> Dataset:
        _check_workers(max_workers, prefetch_factor, executor_type)
        return self.filter_map(fn, schema)

    # Order

    def enumerate(self, count_column: str = "step") -> Dataset:
        return self._each(lambda df: ordering.numbered(df, count_column), f"enumerate[{count_column}]")

    def take(self, n: int) -> Dataset:
        return Dataset(lambda limit: ordering.take(self._build(n if limit is None else min(n, limit)), n), f"take[{n}]({self.name})")

    def stride(self, interval: int, offset: int) -> Dataset:
        need = lambda limit: None if limit is None else max(0, limit - 1) * interval + offset + 1
        if not 0 <= offset < interval:
            raise ValueError("the offset must be at least 0 and less than the interval")
        return Dataset(lambda limit: ordering.stride(self._build(need(limit)), interval, offset), f"stride[{interval},{offset}]({self.name})", self.finite)

    def shuffle(self, buffer_size: int, seed: int = 42) -> Dataset:
        if buffer_size < 1:
            raise ValueError("the buffer holds at least 1 row")

        def build(limit: int | None) -> DataFrame:
            if self.finite or limit is None:
                return ordering.shuffle(self._build(None), buffer_size, seed)
            need = max(0, limit + buffer_size - 1)
            return ordering.shuffle(self._build(need).where(F.col(POS) < need), buffer_size, seed)

        return Dataset(build, f"shuffle[{buffer_size},{seed}]({self.name})", self.finite)

    def batch(self, batch_size: int, collate_fn: Callable[[list[Row]], Row] | None = None, drop_last: bool = False, schema: str | T.StructType | None = None) -> Dataset:
        if batch_size < 1:
            raise ValueError("a batch has at least 1 row")
        build = lambda limit: ordering.batch(self.to_df(None if limit is None or self.finite else limit * batch_size), batch_size, collate_fn, drop_last, schema)
        return Dataset(build, f"batch[{batch_size},{drop_last},{told(collate_fn)}]({self.name})", self.finite)

    # Tokens

    def tokenize(self, tokenizer: Callable[..., Mapping[str, Any]], tokenizer_kwargs: Mapping[str, Any] | None = None, target_column: str = "text", parallel: bool = True, max_workers: int = 1, prefetch_factor: int = 10, ordered: bool = True, executor_type: str = "thread", schema: str | T.StructType | None = None) -> Dataset:
        """Adds what the tokenizer gives for the text; it may be an expression of columns instead, through ``map``."""
        _check_workers(max_workers, prefetch_factor, executor_type)
        options = dict(tokenizer_kwargs or {})

        def fn(row: Row) -> Row:
            return {**row, **tokenizer(row[target_column], **options)}

        return self._each(lambda df: rows.filter_map(df, fn, schema), f"tokenize[{target_column},{told(tokenizer)},{told(options)}]")

    def add_bos_eos(self, bos_token_id: int | None, eos_token_id: int | None, target_column: str = "input_ids") -> Dataset:
        return self._each(lambda df: tokens.add_ends(df, bos_token_id, eos_token_id, target_column), f"ends[{bos_token_id},{eos_token_id},{target_column}]")

    def ensure_bos_eos(self, tokenizer: Any, target_column: str = "input_ids") -> Dataset:
        """The boundary tokens that the tokenizer has but doesn't add itself, as a probe of it shows."""
        ends = ends_to_add(Behaviour.of(tokenizer))
        return self if ends is None else self.add_bos_eos(*ends, target_column)

    def pad(self, pad_values: Mapping[str, int], chunk_length: int) -> Dataset:
        return self._each(lambda df: tokens.pad(df, pad_values, chunk_length), f"pad[{sorted(pad_values.items())},{chunk_length}]")

    def chunk(self, chunk_length: int, target_columns: Sequence[str] = ("input_ids",), drop_remainder: bool = True) -> Dataset:
        return self._some(lambda df, _: tokens.chunk(df, chunk_length, target_columns, drop_remainder), f"chunk[{chunk_length},{list(target_columns)},{drop_remainder}]")

    def concat_chunk(self, chunk_length: int, target_columns: Sequence[str] = ("input_ids",)) -> Dataset:
        return self._some(lambda df, _: tokens.concat_chunk(df, chunk_length, target_columns), f"concat_chunk[{chunk_length},{list(target_columns)}]")

    def pack_chunk(self, chunk_length: int, target_columns: Sequence[str], discard_long_samples: bool = False) -> Dataset:
        return self._some(lambda df, whole: tokens.pack_chunk(df, chunk_length, target_columns, discard_long_samples, whole), f"pack_chunk[{chunk_length},{list(target_columns)},{discard_long_samples}]")

    # Several, and again

    def __add__(self, other: Dataset) -> Dataset:
        return concat_datasets([self, other])

    def cache(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Dataset:
        """Kept by Spark from its first use on; a lost part is made again."""
        kept: dict[int | None, DataFrame] = {}

        def build(limit: int | None) -> DataFrame:
            limit = None if self.finite else limit
            if limit not in kept:
                kept[limit] = self._build(limit).persist(level)
            return kept[limit]

        return Dataset(build, self.name, self.finite)


class Cursor(Iterator[Row]):
    """Rows in order from a position, read in windows where there is no end."""

    def __init__(self, dataset: Dataset, offset: int, window: int):
        self.dataset, self.offset, self.window = dataset, offset, window
        self._rows: Iterator[Row] | None = None

    def _read(self) -> Iterator[Row]:
        end = None if self.dataset.finite else self.offset + self.window
        while True:
            df = self.dataset.to_df(end).where(F.col(POS) >= self.offset).orderBy(POS)
            for r in df.select(*data_columns(df)).toLocalIterator(prefetchPartitions=True):
                yield r.asDict(recursive=True)
            if end is None:
                return
            self.window *= 2
            end = self.offset + self.window

    def __next__(self) -> Row:
        if self._rows is None:
            self._rows = self._read()
        row = next(self._rows)
        self.offset += 1
        return row

    def state_dict(self) -> dict[str, Any]:
        return self.dataset.state(self.offset)

    def close(self) -> None:
        self._rows = iter(())

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def _check_workers(max_workers: int | None, prefetch_factor: int, executor_type: str) -> None:
    if max_workers is not None and max_workers < 1:
        raise ValueError(f"max_workers must be at least 1, not {max_workers}")
    if prefetch_factor < 1:
        raise ValueError(f"prefetch_factor must be at least 1, not {prefetch_factor}")
    if executor_type not in ("process", "thread"):
        raise ValueError(f"unknown executor type {executor_type}")


def from_df(df: DataFrame, *keys: str, repeat: bool = False, shuffle: bool = False, shuffle_seed: int = 42) -> Dataset:
    """A DataFrame ordered by its keys; ``repeat`` goes on with it for ever, ``shuffle`` permutes every epoch."""
    ordered = from_keys(df, *keys)
    name = f"df[{sorted(df.columns)},{keys},{repeat},{shuffle_seed if shuffle else ''}]"
    if not (repeat or shuffle):
        return Dataset(lambda limit: ordered, name)

    def build(limit: int | None) -> DataFrame:
        n = ordered.count()
        if repeat and not n:
            raise ValueError("an empty source can't be repeated")
        epochs = -(-(limit or 0) // n) or 1 if repeat else 1
        return ordering.permuted(ordered, epochs, shuffle_seed, n) if shuffle else ordering.repeated(ordered, epochs, n)

    return Dataset(build, name, finite=not repeat)


def from_sequence(sequence: Sequence[Row], repeat: bool = False, shuffle: bool = False, shuffle_seed: int = 42, schema: str | T.StructType | None = None) -> Dataset:
    if repeat and not len(sequence):
        raise ValueError("an empty source can't be repeated")
    kind = rows.as_schema(schema) if schema is not None else rows.schema_of(list(sequence))
    out = T.StructType([T.StructField(POS, T.LongType()), *kind])
    made = [[i, *(rows.plain(r.get(f.name), f.dataType) for f in kind)] for i, r in enumerate(sequence)]
    df = session().createDataFrame(made, out)
    name = f"sequence[{len(sequence)},{kind.simpleString()},{repeat},{shuffle_seed if shuffle else ''}]"
    n = len(sequence)

    def build(limit: int | None) -> DataFrame:
        epochs = max(1, -(-(limit or 0) // n)) if repeat else 1
        if shuffle:
            return ordering.permuted(df, epochs, shuffle_seed, n)
        return ordering.repeated(df, epochs, n) if repeat else df

    return Dataset(build, name, finite=not repeat)


def from_iterable(iterable: Iterable[Row], repeat: bool = False, endless: bool = False, schema: str | T.StructType | None = None) -> Dataset:
    """Rows of something that can be iterated again. endless: it has no end of its own."""

    def build(limit: int | None) -> DataFrame:
        def passes() -> Iterator[Row]:
            while True:
                empty = True
                for r in iterable:
                    empty = False
                    yield r
                if not repeat or empty:
                    return

        return from_sequence(list(itertools.islice(passes(), limit)), schema=schema)._build(None)

    return Dataset(build, f"iterable[{repeat}]", finite=not (repeat or endless))


def from_files(urls: str | Sequence[str], repeat: bool = False, shuffle_shards: bool = False, format: str = "auto", n_active_shards: int = 10, n_standby_shards: int = 2, timeout: float = 60.0, n_prefetch_samples: int = 10, seed: int = 42, schema: str | T.StructType | None = None) -> Dataset:
    """Sharded files, ``n_active_shards`` at a time in turn. n_standby_shards, timeout and n_prefetch_samples
    are of no effect: tasks read shards side by side."""
    names = shards.urls_of(urls)
    for u in names:
        shards.format_of(u, format)
    if n_active_shards < 1:
        raise ValueError("at least 1 shard is active")

    def build(limit: int | None) -> DataFrame:
        found = shards.payloads(session(), names, format)
        counted = {r["shard"]: r["count"] for r in found.groupBy("shard").count().collect()}  # a number a shard
        counts = [counted.get(k, 0) for k in range(len(names))]
        if repeat and not sum(counts):
            raise ValueError("an empty source can't be repeated")
        kind = rows.as_schema(schema) if schema is not None else shards.schema_of_payloads(found)
        epochs = max(1, -(-(limit or 0) // sum(counts))) if repeat else 1
        plan = shards.segments(counts, shards.epoch_orders(len(names), epochs, shuffle_shards, seed), n_active_shards)
        return shards.merged_rows(shards.typed(found, kind), plan)

    return Dataset(build, f"files[{names},{repeat},{shuffle_shards},{n_active_shards},{seed}]", finite=not repeat)


def from_mds(folder: str, repeat: bool = False) -> Dataset:
    def build(limit: int | None) -> DataFrame:
        df = from_keys(mds.read(session(), folder), "shard", "row").drop("shard", "row")
        if not repeat:
            return df
        n = df.count()
        if not n:
            raise ValueError("an empty source can't be repeated")
        return ordering.repeated(df, max(1, -(-(limit or 0) // n)), n)

    return Dataset(build, f"mds[{folder},{repeat}]", finite=not repeat)


def concat_datasets(sources: Sequence[Dataset]) -> Dataset:
    """Each in turn; one without an end hides those after it."""
    if not sources:
        raise ValueError("nothing to concatenate")
    used: list[Dataset] = []
    for s in sources:
        used.append(s)
        if not s.finite:
            break
    build = lambda limit: combine.concat([s.to_df(None if s.finite else limit) for s in used])
    return Dataset(build, f"concat[{','.join(s.name for s in used)}]", used[-1].finite)


def interleave_datasets(sources: Sequence[Dataset], weights: Sequence[float] | None = None, chunk_size: int = 1024) -> Dataset:
    """By weight; ends where the source whose turn it is has no more rows."""
    weights = [1.0] * len(sources) if weights is None else list(weights)
    if len(weights) != len(sources):
        raise ValueError("there must be one weight for each source")
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    places = combine.slots(weights, chunk_size)
    chosen = [s for s, p in zip(sources, places) if p]

    def build(limit: int | None) -> DataFrame:
        counts = [s.to_df().count() if p and s.finite else None for s, p in zip(sources, places)]
        # Where a source lacks a row, all ends: that bounds what is read of those without an end.
        ends = [n // len(p) * chunk_size + p[n % len(p)] for n, p in zip(counts, places) if n is not None]
        end = min([*ends, *([limit] if limit is not None else [])])
        need = combine.interleave_need(places, chunk_size, end)
        return combine.interleave([s.to_df(n) for s, n in zip(sources, need)], places, chunk_size, counts)

    return Dataset(build, f"interleave[{weights},{chunk_size},{','.join(s.name for s in sources)}]", any(s.finite for s in chosen))
