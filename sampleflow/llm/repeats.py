"""Passages of at least ``min_words`` words that occur more than once.

Two operators find them: ``substring_repeats`` by level-wise doubling and
``suffix_repeats`` by distributed prefix doubling. Both begin with anchors:
windows of half of min_words whose hash is least among those of some passage of
``min_words`` words. Which windows are anchors depends on those words alone, so two
copies of a passage have the same anchors: a passage without a repeated anchor isn't
repeated. About 2 in ``min_words / 2`` windows are anchors, and only those are exchanged
for the whole corpus; what lies near a repeated anchor is then compared. Of texts with
the same words only that of the least doc_id is; the others are repeated as a whole.

Positions are compared in rounds. Each document has a bucket, which holds its positions.
A bucket gives each different key (or pair of ranks) once, with how often it has it and
its first place, to the ranges of the keys' hashes; there equal keys of all buckets meet
and get one rank, which goes back to the buckets if there is another place. So a passage
that very many documents share is one record a bucket, however many they are. Each round is
written, and what it has read is freed.

Words are those of ``flat``; passages are equal when their 64-bit hashes are.
Occurrences are ordered by (doc_id, position); all but the first are ``removed``.

Defined cases, for both: null text and texts of fewer than ``min_words`` words
have no passages; a very long text is taken whole. Rows with a null doc_id have no place
in the order and are left out. Rows that repeat a doc_id are one document (with different
texts: the union of their spans). Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .spread import GATHER, KINDS, Table, bounded_batches, bucket_of, exchange, kinds, of_kind, partitions, table, tidy

#: Bits of the map that spares a join what has no partner: 4 MB.
SIEVE_BITS = 1 << 25

SPANS = "array<struct<begin:int,end:int>>"
_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(words: np.ndarray, counts: np.ndarray, base: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the anchors, and their hashes. Equal least hashes are all anchors."""
    if len(words) < min_words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    width = min_words - base + 1
    h = flat.windows(words, base)
    least = _sliding_min(h, width)
    least[~flat.inside(counts, min_words)[: len(least)]] = 0
    around = np.zeros(len(h) + width - 1, dtype=np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero((~_sliding_min(~around, width) == h) & (h != 0))
    return at, h[at]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _identified(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")


def _mixed(doc: np.ndarray) -> np.ndarray:
    return flat.mix(doc.astype(np.int64).view(np.uint64))


def _new(*keys: np.ndarray) -> np.ndarray:
    """Which records differ from the one before."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _text_hashes(c: flat.Chunk, sums: np.ndarray) -> np.ndarray:
    """One hash of all words of each text."""
    first, count = c.first[:-1], c.counts
    return flat.mix((sums[first + count] - sums[first]) * flat._powers(flat._WORD_BASE, len(sums))[1][first] + count.astype(np.uint64))


_ANCHOR, _HIT, _TEXT, _COPY = range(4)


def marks(docs: DataFrame, base: int, min_words: int) -> Table:
    """(doc_id, hit, words, later): a row for each anchor (at ``hit``) of a document that occurs elsewhere too,
    and one for each document whose ``words`` words are all those of another one; later: of a lesser doc_id."""
    n = partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """What is known here to be repeated is told at once; of each key one record says so to its bucket."""
            key, text, doc, pos = (np.concatenate([x[k] for x in held]) for k in range(4))
            order = np.lexsort((doc, pos, text, key))
            order = order[_new(key[order], text[order], pos[order])]  # of equal texts the least doc_id
            key, text, doc, pos = key[order], text[order], doc[order], pos[order]
            new = _new(key)
            many = np.repeat(np.diff(np.append(np.flatnonzero(new), len(key))) > 1, np.diff(np.append(np.flatnonzero(new), len(key))))
            yield from of_kind(_HIT, bucket_of(_mixed(doc[many]), n), doc[many], pos[many])
            key, text, doc, pos, many = key[new], text[new], doc[new], pos[new], many[new]
            yield from of_kind(_ANCHOR, bucket_of(key, n), key, text, doc, pos, many.astype(np.uint8))
            text, doc, words = (np.concatenate([x[k] for x in texts]) for k in range(3))
            order = np.lexsort((doc, text))
            order = order[_new(text[order], doc[order])]
            text, doc, words = text[order], doc[order], words[order]
            new = _new(text)
            many = np.diff(np.append(np.flatnonzero(new), len(text))) > 1
            yield from of_kind(_COPY, bucket_of(_mixed(doc[~new]), n), doc[~new], words[~new])
            yield from of_kind(_TEXT, bucket_of(text[new], n), text[new], doc[new], words[new], many.astype(np.uint8))

        for batch in batches:
            ids = _ids(batch)
            for c in flat.chunks(batch.column(1)):
                w = c.words()
                at, keys = anchors(w, c.counts, base, min_words)
                own = np.searchsorted(c.first, at, side="right") - 1
                whole = _text_hashes(c, flat.word_sums(w))
                held.append((keys, whole[own], ids[c.rows.start + own], (at - c.first[own]).astype(np.int32)))
                long = np.flatnonzero(c.counts >= min_words)
                texts.append((whole[long], ids[c.rows.start + long], c.counts[long].astype(np.int32)))
                count += len(keys)
            if count >= GATHER:
                yield from flush()
                held, texts, count = [], [], 0
        if held:
            yield from flush()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (x,) = kinds(batches, {_ANCHOR: (np.uint64, np.uint64, np.int64, np.int32, np.uint8), _HIT: (np.int64, np.int32), _TEXT: (np.uint64, np.int64, np.int32, np.uint8), _COPY: (np.int64, np.int32)})

        def out(doc: np.ndarray, hit: np.ndarray | None = None, words: np.ndarray | None = None, later: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), *(pa.nulls(len(doc), pa.int32()) if a is None else pa.array(a.astype(np.int32)) for a in (hit, words, later))], names=["doc_id", "hit", "words", "later"])

        key, text, doc, pos, many, _ = x[_ANCHOR]
        order = np.lexsort((~many, doc, pos, text, key))
        order = order[_new(key[order], text[order], pos[order])]
        key, doc, pos, many = key[order], doc[order], pos[order], many[order]
        begin = np.flatnonzero(_new(key))
        if len(begin):
            size = np.diff(np.append(begin, len(key)))
            found = np.repeat((size > 1) | (np.maximum.reduceat(many, begin) > 0), size)
            yield out(doc[found], pos[found])
        yield out(*x[_HIT][:2])
        text, doc, words, many, _ = x[_TEXT]
        order = np.lexsort((~many, doc, text))
        order = order[_new(text[order], doc[order])]
        text, doc, words, many = text[order], doc[order], words[order], many[order]
        new = _new(text)
        begin = np.flatnonzero(new)
        if len(begin):
            size = np.diff(np.append(begin, len(text)))
            found = np.repeat((size > 1) | (np.maximum.reduceat(many, begin) > 0), size)
            yield out(doc[found], words=words[found], later=~new[found])
        yield out(x[_COPY][0], words=x[_COPY][1], later=np.ones(len(x[_COPY][0])))
        flat.release()

    return table(exchange(_identified(docs).mapInArrow(send, KINDS), n).mapInArrow(find, "doc_id bigint, hit int, words int, later int"))


def _near(c: flat.Chunk, hits: pa.ListArray, base: int, min_words: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the windows of ``min_words`` that hold a repeated anchor, and of those anchors.
    least: all positions of these windows from which so many words follow, not their first alone."""
    least = least or min_words
    part = hits.slice(c.rows.start, len(c.rows))
    cuts = part.offsets.to_numpy()
    values = part.values.to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]]
    low = np.repeat(c.first[:-1], np.diff(cuts))
    anchor = low + values
    change = np.zeros(len(c.start) + 1, dtype=np.int64)
    np.add.at(change, np.maximum(low, anchor - (min_words - base)), 1)
    np.add.at(change, np.minimum(anchor + 1 + min_words - least, len(c.start)), -1)
    return np.flatnonzero((np.cumsum(change)[:-1] > 0) & flat.inside(c.counts, least)), np.unique(anchor)


#: Kinds of rows of the rounds: places before the first, keys, places with the number of their key,
#: ranks of the keys by number, and what has been found: spans and levels.
_PLACE, _KEY, _HELD, _RANK, _FOUND, _LEVEL = range(6)
_PLACE_OF = (np.uint64, np.int64, np.int32, np.uint32)
_KEY_OF = (np.uint64, np.uint64, np.uint32, np.uint32, np.int64, np.int32, np.int32)
_HELD_OF = (np.int64, np.int32, np.uint32, np.uint32)
_RANK_OF = (np.uint32, np.uint64, np.uint8)


def _sifted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Of rows (doc_id, text) those whose doc_id may be among the keys; the others surely aren't. A bit map of
    SIEVE_BITS, whatever there is; it only spares the join that follows what it can do without."""
    bits = [F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), F.lit(SIEVE_BITS)) for k in range(2)]
    each = keys.select(F.explode(F.array(*bits)).alias("bit")).select((F.col("bit") + 1).alias("bit"))
    maps = each.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    found = np.zeros((SIEVE_BITS >> 15, 4096), dtype=np.uint8)
    for r in maps:
        found[r.part - 1] = np.frombuffer(r.map, dtype=np.uint8)
    packed = found.ravel()

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (2, 3))
            keep = (packed[a >> 3] >> (a & 7).astype(np.uint8)) & (packed[b >> 3] >> (b & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(keep.astype(bool))).select(["doc_id", "text"])
        flat.release()

    return rows.select("doc_id", "text", bits[0].alias("a"), bits[1].alias("b")).mapInArrow(may, "doc_id bigint, text string")


def _places(docs: DataFrame, found: Table, base: int, min_words: int, width: int) -> Table:
    """The positions of windows of min_words that hold a repeated anchor, each with the hash of the
    ``width`` words that begin there, by their document's bucket."""
    n = partitions(docs.sparkSession)
    hits = found.df.where("hit is not null").groupBy("doc_id").agg(F.collect_set("hit").alias("hits"))
    rows = _sifted(_identified(docs), hits.select("doc_id")).join(hits, "doc_id").select("doc_id", "text", "hits")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            for c in flat.chunks(batch.column(1)):
                sums = flat.word_sums(c.words())
                at, _ = _near(c, batch.column(2), base, min_words, least=width)
                own = np.searchsorted(c.first, at, side="right") - 1
                # Tells texts apart that share a doc_id: a passage goes on in its own text alone.
                text = _text_hashes(c, sums).astype(np.uint32)
                doc = ids[c.rows.start + own]
                yield from of_kind(_PLACE, bucket_of(_mixed(doc), n), flat.window_at(sums, at, width), doc, (at - c.first[own]).astype(np.int32), text[own])
        flat.release()

    return table(rows.mapInArrow(send, KINDS))


def _offer(a: np.ndarray, b: np.ndarray, doc: np.ndarray, pos: np.ndarray, text: np.ndarray, own: int, n: int) -> Iterator[pa.RecordBatch]:
    """Of the places of a bucket, in order, each different key (a, b) once, and the places with its number."""
    if not len(a):
        return
    order = np.lexsort((pos, doc, b, a))
    new = _new(a[order], b[order])
    begin = np.flatnonzero(new)
    other = new | _new(doc[order], pos[order])  # texts of one doc_id may share a place
    count = np.add.reduceat(other, begin, dtype=np.uint32)
    head = order[begin]
    by_place = np.argsort(head)
    number = np.empty(len(begin), dtype=np.uint32)
    number[by_place] = np.arange(len(begin), dtype=np.uint32)
    of = np.empty(len(a), dtype=np.uint32)
    of[order] = number[np.cumsum(new) - 1]
    yield from of_kind(_HELD, np.full(len(a), own, np.int32), doc, pos, text, of)
    head, count = head[by_place], count[by_place]
    a, b = a[head], b[head]
    yield from of_kind(_KEY, bucket_of(flat.mix(flat.mix(a) + b), n), a, b, np.arange(len(a), dtype=np.uint32), count, doc[head], pos[head], np.full(len(a), own, np.int32))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal keys of all buckets, sorted, get one rank; those with another place go back to their buckets."""
    for x in kinds(batches, {_KEY: _KEY_OF}, pass_on=(_HELD, _FOUND, _LEVEL)):
        if isinstance(x, pa.RecordBatch):
            yield x
            continue
        a, b, number, count, doc, pos, src, bucket = x[_KEY]
        if not len(a):
            continue
        order = np.lexsort((pos, doc, b, a))
        new = _new(a[order], b[order])
        begin = np.flatnonzero(new)
        many = np.add.reduceat(count[order], begin, dtype=np.int64) > 1
        size = np.diff(np.append(begin, len(a)))
        rank = np.repeat(np.arange(len(begin), dtype=np.uint64) | np.uint64(int(bucket[0]) << 40), size)
        keep = np.flatnonzero(np.repeat(many, size))
        keep = keep[np.lexsort((number[order[keep]], src[order[keep]]))]
        at = order[keep]
        yield from of_kind(_RANK, src[at], number[at], rank[keep], (~new[keep]).astype(np.uint8))
    flat.release()


def _ranked(x: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(doc, text, pos, rank, later) of the places whose key has another one, in order."""
    doc, pos, text, number, _ = x[_HELD]
    named, rank, later, _ = x[_RANK]
    if not len(named):
        return doc[:0], text[:0], pos[:0], rank, later
    rank_of, later_of = np.zeros(int(number.max()) + 1, dtype=np.uint64), np.full(int(number.max()) + 1, 2, dtype=np.uint8)
    rank_of[named], later_of[named] = rank, later
    keep = later_of[number] < 2
    doc, pos, text, number = doc[keep], pos[keep], text[keep], number[keep]
    order = np.lexsort((pos, doc, number))
    begin = np.flatnonzero(_new(number[order]))
    head = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
    again = np.empty(len(order), dtype=bool)
    again[order] = (doc[order] != doc[head]) | (pos[order] != pos[head])
    later = later_of[number].astype(bool) | again
    order = np.lexsort((pos, text, doc))
    number = number[order]
    return doc[order], text[order], pos[order], rank_of[number], later[order]


def _pairs(doc: np.ndarray, text: np.ndarray, pos: np.ndarray, rank: np.ndarray, step: int, own: int, n: int) -> Iterator[pa.RecordBatch]:
    """The keys (rank, rank of the place ``step`` words on) of ordered places."""
    if len(doc):
        code = (np.cumsum(_new(doc, text)) << 32) + pos
        there = np.searchsorted(code, code + step)
        there[there == len(code)] = 0
        has = np.flatnonzero(code[there] == code + step)
        yield from _offer(rank[has], rank[there[has]], doc[has], pos[has], text[has], own, n)


def _first(n: int, step: int | None) -> Callable:
    """The first round's keys: pairs of hashes ``step`` words apart, or single hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (x,) = kinds(batches, {_PLACE: _PLACE_OF})
        h, doc, pos, text, bucket = x[_PLACE]
        if len(h):
            order = np.lexsort((pos, text, doc))
            order = order[_new(doc[order], text[order], pos[order])]  # rows may be repeated
            h, doc, pos, text = h[order], doc[order], pos[order], text[order]
            if step:
                yield from _pairs(doc, text, pos, h, step, int(bucket[0]), n)
            else:
                yield from _offer(h, np.zeros(len(h), dtype=np.uint64), doc, pos, text, int(bucket[0]), n)
        flat.release()

    return run


def _next(n: int, length: int, step: int | None, spans: bool, level: bool) -> Callable:
    """Of the places ranked by ``length`` words, the next round's keys (of ranks ``step`` words apart), and what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in kinds(batches, {_HELD: _HELD_OF, _RANK: _RANK_OF}, pass_on=(_FOUND, _LEVEL)):
            if isinstance(x, pa.RecordBatch):
                yield x
                continue
            own = x[_HELD][-1]
            doc, text, pos, rank, later = _ranked(x)
            if not len(doc):
                continue
            own = int(own[0])
            if spans:
                for only, kind in ((np.ones(len(doc), dtype=bool), 0), (later, 1)):
                    d, begin, end = _union(doc[only], pos[only], pos[only] + length)
                    yield from of_kind(_FOUND, np.full(len(d), own, np.int32), d, begin, end, np.full(len(d), kind, np.uint8))
            if level:
                ids = np.unique(doc)
                yield from of_kind(_LEVEL, np.full(len(ids), own, np.int32), ids, np.full(len(ids), length, np.int32))
            if step:
                yield from _pairs(doc, text, pos, rank, step, own, n)
        flat.release()

    return run


def _round(work: DataFrame, n: int, then: Callable) -> Table:
    return table(exchange(exchange(work, n).mapInArrow(_merge, KINDS), n).mapInArrow(then, KINDS))


def _union(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of words that are covered by spans or lie between two that touch."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, begin.astype(np.int32), end.astype(np.int32)
    base = (np.cumsum(_new(doc)) << 32).astype(np.int64)
    upto = np.maximum.accumulate(base + end)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = base[1:] + begin[1:] > upto[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], begin[at].astype(np.int32), (upto[last] - base[last]).astype(np.int32)


def _listed(docs: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    cuts = np.append(np.searchsorted(doc, docs), len(doc)).astype(np.int32)
    return pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["begin", "end"]))


def _result(last: DataFrame, found: Table, n: int, min_words: int) -> DataFrame:
    """(doc_id, repeated, removed, longest): what the rounds found, and the documents with all the words of another."""

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, words, later = (batch.column(k).to_numpy() for k in range(3))
            zero = np.zeros(len(doc), dtype=np.int32)
            level = np.full(len(doc), min_words, dtype=np.int32)
            while (more := level * 2 <= words).any():
                level[more] *= 2
            for only, kind in ((later >= 0, 0), (later > 0, 1)):
                yield from of_kind(_FOUND, bucket_of(_mixed(doc[only]), n), doc[only], zero[only], words[only].astype(np.int32), np.full(int(only.sum()), kind, np.uint8))
            yield from of_kind(_LEVEL, bucket_of(_mixed(doc), n), doc, level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (x,) = kinds(batches, {_FOUND: (np.int64, np.int32, np.int32, np.uint8), _LEVEL: (np.int64, np.int32)})
        doc, begin, end, kind, _ = x[_FOUND]
        if not len(doc):
            return
        docs = np.unique(doc)
        longest = np.full(len(docs), min_words, dtype=np.int32)
        np.maximum.at(longest, np.searchsorted(docs, x[_LEVEL][0]), x[_LEVEL][1])
        lists = [_listed(docs, *_union(doc[kind == k], begin[kind == k], end[kind == k])) for k in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(docs), *lists, pa.array(longest)], names=["doc_id", "repeated", "removed", "longest"])

    whole = found.df.where("words is not null").select("doc_id", "words", "later").mapInArrow(copies, KINDS)
    seen = last.where(F.col("kind").isin(_FOUND, _LEVEL)).unionByName(whole)
    return exchange(seen, n).mapInArrow(run, f"doc_id bigint, repeated {SPANS}, removed {SPANS}, longest int")


def substring_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Level-wise doubling: (doc_id, repeated, removed, longest) of each document with a repeated passage.

    The levels are windows of min_words (all that hold a repeated anchor; these decide
    the spans), then of twice the length from all positions whose window, and the one that
    follows it, are repeated, until none is. ``repeated`` are the word spans covered by
    windows of min_words that occur at another place, ``removed`` those covered by windows
    that occur at an earlier one. ``longest`` is the greatest level at which a window of the
    document was repeated.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    spark, base = docs.sparkSession, (min_words + 1) // 2
    n = partitions(spark)
    found = marks(docs, base, min_words)
    start = _places(docs, found, base, min_words, min_words)
    level, have = min_words, start
    work = exchange(start.df, n).mapInArrow(_first(n, None), KINDS)
    while True:
        before, have = have, _round(work, n, _next(n, level, level, level == min_words, True))
        before.drop()
        tidy(spark)
        if have.df.where(F.col("kind") == _KEY).isEmpty():
            break
        work = have.df
        level *= 2
    out = table(_result(have.df, found, n, min_words))
    for t in (have, found):
        t.drop()
    return out.df


def suffix_repeats(docs: DataFrame, threshold: int = 50, base: int | None = None) -> DataFrame:
    """Distributed prefix doubling: (doc_id, repeated, removed) of each document with a repeated passage.

    The positions near a repeated anchor begin with the hash of ``base`` words (4, or fewer
    if the threshold is) as their rank. In each round the pairs (rank at p, rank at p + offset) are sorted, equal pairs get
    one new rank, and positions whose pair is unique drop out; the offset is the
    ranked length, and in the last round what makes it the threshold. The order of pairs is that
    of their hashes' ranges, then of the ranks: all that matters is that equal ones meet.
    ``repeated`` and ``removed`` are spans of words as in ``substring_repeats``.
    """
    if threshold < 2:
        raise ValueError("threshold must be at least 2")
    base = min(4, threshold - 1) if base is None else base
    if not 1 <= base < threshold:
        raise ValueError("base must be at least 1 and less than the threshold")
    spark, wide = docs.sparkSession, (threshold + 1) // 2
    n = partitions(spark)
    found = marks(docs, wide, threshold)
    have = _places(docs, found, wide, threshold, base)
    tidy(spark)
    length, step = base, min(base, threshold - base)
    work = exchange(have.df, n).mapInArrow(_first(n, step), KINDS)
    while True:
        length += step
        step = min(length, threshold - length)
        before, have = have, _round(work, n, _next(n, length, step or None, not step, False))
        before.drop()
        tidy(spark)
        if not step or have.df.where(F.col("kind") == _KEY).isEmpty():
            break
        work = have.df
    out = table(_result(have.df, found, n, threshold).drop("longest"))
    for t in (have, found):
        t.drop()
    return out.df


def without_spans(texts: pa.Array, removed: pa.ListArray) -> pa.Array:
    """The texts without the words in their spans, each word up to the next one; what is left of a
    text whose last words go loses its trailing white space."""
    out: list[str] = []
    for c in flat.chunks(texts):
        for k, row in enumerate(c.rows):
            low, high = int(c.cuts[k]), int(c.cuts[k + 1])
            start = c.start[c.first[k] : c.first[k + 1]]
            parts, at, last = [], low, False
            for span in removed[row].as_py() or []:
                begin, end = span["begin"], min(span["end"], len(start))
                if begin < end:
                    parts.append(c.data[at : start[begin]].tobytes())
                    last = end == len(start)
                    at = high if last else int(start[end])
            parts.append(c.data[at:high].tobytes())
            joined = b"".join(parts).decode("utf-8", "replace")
            out.append(joined.rstrip() if last else joined)
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the ``removed`` spans cut from their text; a document of which no word is left goes.
    Other rows and columns stay as they are, but n_chars follows the text where there is one."""

    bounded_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def cut(text: pa.Array, removed: pa.Array) -> pa.Array:
        return without_spans(text, removed)

    names = {c.lower() for c in docs.columns}
    spare = "_cut"
    while spare in names or spare + "_id" in names:
        spare = "_" + spare
    own = spans.where("size(removed) > 0").select(F.col("doc_id").alias(spare + "_id"), F.col("removed").alias(spare))
    with_cut = docs.join(own, F.col("doc_id") == F.col(spare + "_id"), "left").drop(spare + "_id")
    changed = F.col(spare).isNotNull() & F.col("text").isNotNull()
    kept = with_cut.withColumn(spare, F.when(changed, cut(F.when(changed, F.col("text")), F.when(changed, F.col(spare)))))
    kept = kept.where(F.col(spare).isNull() | (F.length(spare) > 0))
    text = F.coalesce(F.col(spare), F.col("text").cast("string"))
    own_name = lambda c: "`" + c.replace("`", "``") + "`"
    columns = {c: text if c.lower() == "text" else F.when(F.col(spare).isNotNull(), F.length(spare).cast("bigint")).otherwise(F.col(own_name(c))) if c.lower() == "n_chars" else F.col(own_name(c)) for c in docs.columns}
    return kept.select(*(v.alias(c) for c, v in columns.items()))
