"""N-gram Jaccard join: documents whose sets of word n-grams are alike.

1. Each text's set of hashed n-grams is exchanged by ranges of the hash, where an
   n-gram's documents are counted; the n-grams that occur in other texts too go on, with
   how common they are, to their document. A document fewer than threshold x |set| of
   whose n-grams occur elsewhere has no partner and goes. This is exact, and removes
   what only shares some passages. An n-gram of more than 1 in ``HOT_SHARE`` of the texts that
   a task holds at once goes from there to its documents, as one of the commonest, so that
   no task gets all the documents of such an n-gram.
2. Documents with equal sets are one node.
3. A node's prefix are its |set| - threshold x |set| + 1 rarest n-grams (fewest documents
   first, then by hash); alike sets share one. Nodes that share one, and may by their
   sizes be alike, are brought together: the components of that graph are joined apart from
   each other. A component too large for one task is cut into blocks by size, and each pair
   of blocks that may hold partners is a task.
4. A task sorts its sets by size and indexes their n-grams; each n-gram's list is in
   that order, so a set skips to the block of each list that holds sets of a fitting
   size. The overlaps of a set with all others are counted from its lists or, where
   a set much like it has been counted before, derived: from that set's overlaps, less
   the lists of the n-grams that it lacks, plus those of the ones it has besides.
5. A task gives, of each of its nodes, with how many documents it is alike, and a
   connection to the least node alike. The connected nodes are classes.

Every two documents with Jaccard similarity >= threshold are linked (up to equal hashes:
of n-grams, 48 bits beside the number of their range; of sets, 64 bits of two sums).

Defined cases: a text of fewer words than n has one n-gram, all its words; null and
empty texts have none and no links; a very long text is one set. Null doc_ids are left
out. Rows that repeat a doc_id and a set are one document; with different sets they are
documents of their own under one doc_id. An empty table has no links. Equal similarities
need no order, as all count. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .graph import classes, components, least_labels
from .repeats import _identified, _ids
from .spread import GATHER, KINDS, bucket_of, exchange, kinds, of_kind, partitions, table, tidy

#: Bytes of sets, and sets, that a task of the join takes of one block.
BLOCK_BYTES, BLOCK_SETS = 16 << 20, 2048
#: An n-gram is common where it is in more than 1 in HOT_SHARE of the texts at hand, and in more than HOT_LEAST.
HOT_SHARE, HOT_LEAST = 64, 64

_LOW = np.uint64((1 << 48) - 1)
_COMMONEST = 255
_HOME, _COMMON, _DIRECT, _SET, _SHARED = range(5)


def grams(c: flat.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, ascending: (text within the chunk, hash)."""
    words, counts = c.words(), c.counts
    h = flat.windows(words, n)
    at = np.flatnonzero(flat.inside(counts, n)[: len(h)])
    short = np.flatnonzero((counts > 0) & (counts < n))
    own = np.concatenate([np.searchsorted(c.first, at, side="right") - 1, short])
    sums = flat.word_sums(words)
    h = np.concatenate([h[at], *(flat.window_at(sums, c.first[k : k + 1], int(counts[k])) for k in short)])
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    return own[new], h[new]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values[cuts[i]:cuts[i + 1]]."""
    offsets = ((cuts - cuts[0]) * values.itemsize).astype(np.int32)
    data = np.ascontiguousarray(values[cuts[0] : cuts[-1]])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def sets(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(row, doc_id, node, size, least, grams): each text enough of whose n-grams occur in another one.
    grams are these n-grams, as packed numbers; ``least`` those of them in the text's prefix."""
    parts = min(partitions(docs.sparkSession), 1 << 16)

    def home(h: np.ndarray) -> np.ndarray:
        return bucket_of(h, parts)

    def numbered(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
        return bucket.astype(np.uint64) << np.uint64(48) | low

    def of_row(row: np.ndarray) -> np.ndarray:
        return bucket_of(flat.mix(row), parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, texts, held, count = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, row = (np.concatenate([x[k] for x in held]) for k in range(2))
            order = np.argsort(h, kind="stable")
            begin = _groups(h[order])
            many = np.diff(np.append(begin, len(h)))
            hot = many > max(HOT_LEAST, len(np.unique(row)) // HOT_SHARE)
            keys = h[order[begin[hot]]]
            yield from of_kind(_COMMON, home(keys), (keys & _LOW).astype(np.uint32), ((keys & _LOW) >> np.uint64(32)).astype(np.uint16))
            is_hot = np.zeros(len(h), dtype=bool)
            is_hot[order] = np.repeat(hot, many)
            yield from of_kind(_DIRECT, of_row(row[is_hot]), numbered(home(h[is_hot]), h[is_hot] & _LOW), row[is_hot])
            h, row = h[~is_hot], row[~is_hot]
            low = h & _LOW
            yield from of_kind(_HOME, home(h), low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16), row)

        for batch in batches:
            ids = _ids(batch)
            for c in flat.chunks(batch.column(1)):
                own, h = grams(c, n)
                if not len(h):
                    continue
                begin = _groups(own)
                row = base + texts + np.arange(len(begin), dtype=np.uint64)
                texts += len(begin)
                size = np.diff(np.append(begin, len(h)))
                a, b = np.add.reduceat(h, begin), np.add.reduceat(flat.mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin)
                node = flat.mix(a ^ flat.mix(b + size.astype(np.uint64)))
                yield from of_kind(_SET, of_row(row), row, ids[c.rows.start + own[begin]], node, size.astype(np.uint32))
                held.append((h, np.repeat(row, size)))
                count += len(h)
                if count >= GATHER:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To their texts, the n-grams that other texts have too, each with the class of its count."""
        for x in kinds(batches, {_HOME: (np.uint32, np.uint16, np.uint64), _COMMON: (np.uint32, np.uint16)}, pass_on=(_DIRECT, _SET)):
            if isinstance(x, pa.RecordBatch):
                yield x
                continue
            low, high, row, bucket = x[_HOME]
            key = numbered(bucket, high.astype(np.uint64) << np.uint64(32) | low)
            low, high, bucket = x.pop(_COMMON)
            common = np.unique(numbered(bucket, high.astype(np.uint64) << np.uint64(32) | low))
            x.clear()
            order = np.argsort(key, kind="stable")
            begin = _groups(key[order])
            many = np.diff(np.append(begin, len(key)))
            is_common = common[np.searchsorted(common, key[order[begin]]) % len(common)] == key[order[begin]] if len(common) else np.zeros(len(begin), dtype=bool)
            of = np.where(is_common, _COMMONEST, np.minimum(_COMMONEST - 1, 8 * np.log2(np.maximum(many, 1)))).astype(np.uint8)
            keep = np.flatnonzero(np.repeat(is_common | (many > 1), many))
            rank = np.repeat(of, many)[keep]
            at = order[keep]
            back = np.argsort(row[at], kind="stable")
            yield from of_kind(_SHARED, of_row(row[at[back]]), key[at[back]], row[at[back]], rank[back])
        flat.release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (x,) = kinds(batches, {_DIRECT: (np.uint64, np.uint64), _SHARED: (np.uint64, np.uint64, np.uint8), _SET: (np.uint64, np.int64, np.uint64, np.uint32)})
        row, doc, node, size, _ = x[_SET]
        order = np.argsort(row)
        row, doc, node, size = row[order], doc[order], node[order], size[order].astype(np.int64)
        key = np.concatenate([x[_DIRECT][0], x[_SHARED][0]])
        whose = np.searchsorted(row, np.concatenate([x[_DIRECT][1], x[_SHARED][1]]))
        rank = np.concatenate([np.full(len(x[_DIRECT][0]), _COMMONEST, np.uint8), x[_SHARED][2]])
        x.clear()
        have = np.bincount(whose, minlength=len(row))
        need = np.ceil(size * threshold - 1e-9).astype(np.int64)
        chosen = have >= np.maximum(need, 1)
        keep = chosen[whose]
        key, whose, rank = key[keep], whose[keep], rank[keep]
        order = np.lexsort((key, rank, whose))
        first, whose = key[order], whose[order]
        cuts = np.append(0, np.cumsum(have[chosen]))
        take = (have - need + 1)[chosen]  # the n-grams of no other text come before
        prefix = first[np.arange(len(first)) - np.repeat(cuts[:-1], np.diff(cuts)) < np.repeat(take, np.diff(cuts))]
        ends = np.append(0, np.cumsum(take))
        key = first[np.lexsort((first, whose))]
        row, doc, node, size = row[chosen], doc[chosen], node[chosen], size[chosen]
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + (1 << 22), side="right")) - 1)
            yield pa.RecordBatch.from_pydict({"row": row[at:to].view(np.int64), "doc_id": doc[at:to], "node": node[at:to].view(np.int64), "size": size[at:to], "least": _binary(prefix, ends[at : to + 1]), "grams": _binary(key, cuts[at : to + 1])})
            at = to
        flat.release()

    sent = exchange(_identified(docs).mapInArrow(send, KINDS), parts)
    counted = exchange(sent.mapInArrow(shared, KINDS), parts)
    return counted.mapInArrow(gather, "row bigint, doc_id bigint, node bigint, size bigint, least binary, grams binary")


def links(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect any two nodes which may be alike: they share an n-gram of their
    prefixes, with no gap in size between them. prefixes: (node, size, least)."""
    parts = partitions(prefixes.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            """Of the nodes of one size that share an n-gram the first is sent, the others are linked to it here."""
            key, node, size = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.lexsort((node, size, key))
            key, node, size = key[order], node[order], size[order]
            begin = _groups(key, size)
            head = np.repeat(node[begin], np.diff(np.append(begin, len(key))))
            other = np.flatnonzero(head != node)
            a, b = node[other], head[other]
            if len(a):
                again = np.lexsort((b, a))
                a, b = a[again], b[again]
                only = _groups(a, b)
                yield from of_kind(1, bucket_of(flat.mix(a[only]), parts), a[only], b[only])
            m = flat.mix(key[begin])  # spreads the n-grams' ranges over all buckets
            yield from of_kind(0, bucket_of(m, parts), m.astype(np.uint32), (m >> np.uint64(32)).astype(np.uint16), node[begin], size[begin])

        for batch in batches:
            for node, size, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                h = np.frombuffer(packed, dtype=np.uint64)
                held.append((h, np.full(len(h), node, np.int64).view(np.uint64), np.full(len(h), size, np.uint32)))
                count += len(h)
            if count >= GATHER:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (x,) = kinds(batches, {0: (np.uint32, np.uint16, np.uint64, np.uint32), 1: (np.uint64, np.uint64)})
        low, high, doc, size, _ = x[0]
        if len(low):
            key = high.astype(np.uint64) << np.uint64(32) | low
            order = np.lexsort((size, key))
            key, doc, size = key[order], doc[order], size[order].astype(np.float64)
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (size[:-1] < size[1:] * threshold - 1e-9)
            node, label = least_labels(doc, np.cumsum(new) - 1, *x[1][:2])
        else:
            node, label = least_labels(doc, np.zeros(0, dtype=np.int64), *x[1][:2])
        at = np.flatnonzero(label != node)
        yield pa.RecordBatch.from_pydict({"a": node[at].view(np.int64), "b": label[at].view(np.int64)})

    sent = exchange(prefixes.select("node", "size", "least").mapInArrow(send, KINDS), parts)
    return sent.mapInArrow(link, "a bigint, b bigint")


def join_sets(parts: list[np.ndarray], sides: np.ndarray, threshold: float, sizes: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(set, sets alike that come after it in order of size, similarities) among distinct sets with unlike
    sides, or among all where the sides are the same. sizes: where elements that no two sets share are left out."""
    length = np.array([len(p) for p in parts])
    size = length if sizes is None else sizes
    order = np.argsort(size, kind="stable")
    sides, size, length, parts = sides[order], size[order], length[order], [parts[k] for k in order]
    n, one = len(parts), len(np.unique(sides)) == 1
    _, token = np.unique(np.concatenate(parts), return_inverse=True)
    code = np.sort(token * n + np.repeat(np.arange(n), length))  # the lists, one after the other, each by size
    cuts = np.append(0, np.cumsum(length))
    low = np.searchsorted(size, np.ceil(size * threshold - 1e-9))
    high = np.searchsorted(size, np.floor(size / threshold + 1e-9), side="right")

    def counted(tokens: np.ndarray, begin: int, end: int) -> np.ndarray:
        """How many of the tokens' lists hold each set of begin:end; the lists' other blocks are skipped."""
        i, j = np.searchsorted(code, tokens * n + begin), np.searchsorted(code, tokens * n + end)
        span = j - i
        at = np.repeat(i - np.cumsum(span) + span, span) + np.arange(span.sum())
        return np.bincount(code[at] % n - begin, minlength=end - begin)

    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    best, whose = np.zeros(n, dtype=np.int64), np.full(n, -1)
    for x in range(n):
        begin, end = int(low[x]), int(high[x])
        if end - begin < 2:
            continue
        own = token[cuts[x] : cuts[x + 1]]
        y = int(whose[x])
        if y >= 0 and length[x] + length[y] - 2 * best[x] < length[x]:
            like, have = kept[y]
            lacks, has = np.setdiff1d(like, own, assume_unique=True), np.setdiff1d(own, like, assume_unique=True)
            b, e = max(begin, int(low[y])), min(end, int(high[y]))
            # sizes that y skipped are counted
            overlap = np.concatenate(
                [
                    counted(own, begin, b) if b > begin else np.zeros(0, dtype=np.int64),
                    have[b - int(low[y]) : e - int(low[y])] - counted(lacks, b, e) + counted(has, b, e),
                    counted(own, e, end) if end > e else np.zeros(0, dtype=np.int64),
                ]
            )
        else:
            overlap = counted(own, begin, end)
            kept[x] = own, overlap
            better = overlap > best[begin:end]
            best[begin:end][better] = overlap[better]
            whose[begin:end][better] = x
        similar = overlap / (size[x] + size[begin:end] - overlap)
        z = np.flatnonzero(similar >= threshold)
        z = z[(z + begin > x) & ((sides[z + begin] != sides[x]) | one)]
        if len(z):
            yield int(order[x]), order[z + begin], similar[z]


def near_classes(docs: DataFrame, threshold: float = 0.6, n: int = 3) -> DataFrame:
    """(doc_id, class_id, links) of each document with a link: with how many other documents its set is
    alike, and the least doc_id that it is connected with. All others are classes of their own."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("the threshold must be over 0 and at most 1, n at least 1")
    spark = docs.sparkSession
    parts = partitions(spark)
    whole = table(sets(docs, n, threshold))
    tidy(spark)
    members = whole.df.select("node", "doc_id").distinct()
    one_row = whole.df.groupBy("node").agg(F.min("row").alias("row"), F.min("size").alias("size"))
    nodes = table(members.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("weight")).join(one_row, "node"))
    tidy(spark)  # the last job of all is still referred to
    near = components(links(whole.df, threshold))
    tidy(spark)
    blocks = _blocks(nodes.df.join(near.df, "node"), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def result() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                node, side, weight, size = (np.array([x[k] for x in held]) for k in range(4))
                yield from _alike([np.frombuffer(x[4], dtype=np.uint64) for x in held], node, side, weight, size, threshold)

        for batch in batches:
            for root, i, j, *own in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, i, j) != key:
                    yield from result()
                    key, held = (root, i, j), []
                held.append(own)
        yield from result()
        flat.release()

    tasks = whole.df.select("row", "grams").join(blocks, "row").select("root", "i", "j", "node", "block", "weight", "size", "grams")
    tasks = tasks.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    found = table(tasks.mapInArrow(run, "node bigint, links bigint, root bigint"))
    near.drop()
    out = classes(members, found.df)
    for t in (whole, nodes, found):
        t.drop()
    tidy(spark)
    return out.df


def _alike(parts: list[np.ndarray], node: np.ndarray, side: np.ndarray, weight: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, links, root) of the nodes of a task that are alike with another one."""
    count, label = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
    for x, z, _ in join_sets(parts, side, threshold, size):
        count[x] += weight[z].sum()
        count[z] += weight[x]
        old = np.unique(np.append(label[z], label[x]))
        if len(old) > 1:
            label[np.isin(label, old)] = old[0]
    at = np.flatnonzero(count)
    if len(at):
        least = node.copy()
        np.minimum.at(least, label, node)
        yield pa.RecordBatch.from_pydict({"node": node[at], "links": count[at], "root": least[label[at]]})


def _blocks(sized: DataFrame, threshold: float) -> DataFrame:
    """(row, node, weight, size, root, i, j, block): the tasks of each node. A component's nodes, by size,
    are cut into blocks; a task joins block i with a block j >= i that has sets of a fitting size. The cuts
    come from counts of each size; the nodes of a size that fills more than a block are spread by hash."""
    unit = f"greatest(size * 8D / {BLOCK_BYTES}, 1D / {BLOCK_SETS})"
    by = "partition by root order by size rows between unbounded preceding and 1 preceding"
    fills = sized.groupBy("root", "size").agg(F.sum(F.expr(unit)).alias("fill"))
    cut = fills.selectExpr("root", "size", f"cast(coalesce(sum(fill) over ({by}), 0D) as bigint) as at", "cast(greatest(1, ceil(fill)) as bigint) as span")
    placed = sized.join(cut, ["root", "size"]).withColumn("block", F.col("at") + F.pmod(F.xxhash64("node"), F.col("span"))).drop("at", "span")
    bounds = placed.groupBy("root", "block").agg(F.min("size").alias("least_size"), F.max("size").alias("most_size"), F.count(F.lit(1)).alias("n"))
    pairs = bounds.alias("x").join(bounds.alias("y"), "root").where(f"x.block <= y.block and x.most_size >= y.least_size * {threshold!r} - 1e-9 and y.most_size >= x.least_size * {threshold!r} - 1e-9 and x.n + y.n > if(x.block = y.block, 2, 1)")
    pairs = pairs.select("root", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    tasks = pairs.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return placed.join(tasks, ["root", "block"]).select("row", "node", "weight", "size", "root", "i", "j", "block")


def first_of_each_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` without those that are in the class of a lesser doc_id. Rows of one doc_id go or stay together."""
    name = "_gone"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    gone = groups.where("class_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
