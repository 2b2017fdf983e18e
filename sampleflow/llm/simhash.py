"""SimHash fingerprints, and which documents are within a Hamming radius of each other.

Each distinct word of a text votes on 64 signed bits by its hash, with the weight
1 + floor(log2(occurrences)); a bit is set where the votes are positive. The 64 bits
are cut into radius + 3 blocks. Two fingerprints that differ in at most ``radius``
bits agree in three blocks at least, so with one table for every choice of three
blocks, keyed by these, they meet in one of the tables. Each pair counts in the
first table where it meets; nothing is approximate.

Distinct fingerprints are compared, each with the number of its documents. A task gives,
of each of its fingerprints, with how many documents of others it is linked, and a
connection to the least; pairs aren't written. Connected documents are a class.

NEAR is taken from the distances of near copies at sf0.1 (1,135 pairs of distinct sets
of 3-grams with Jaccard similarity >= 0.6): 23 % of them are within 3 bits, 81 % within
7, 89 % within 8, 94 % within 9. Of the 1,085 pairs of fingerprints within 8 bits about
92 % are such copies; beyond it chance pairs take over (1,941 within 10, 8,307 within 12).

With T tables of b bits a key, N fingerprints meet T x N^2 / 2^(b+1) times by chance: few for
the 17 bits of radius 8 up to some 10 million, too many beyond a billion, where the
radius must be less (3: 35 tables of the 36 bits that four blocks have; ``agree`` sets their number).

Defined cases: null and empty texts, and texts without words, have no fingerprint and no
links; very long texts are taken whole. Null doc_ids are left out. Rows that repeat a doc_id
count once (with different texts: the least fingerprint). Equal distances need no order, as
all within the radius count. An empty table has no links. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .graph import classes, least_labels
from .spread import Gather, bounded_batches, exchange, partitions, per_task, schema, table

#: Bits within which near copies are looked for.
NEAR = 8


def fingerprints(c: flat.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Of each text with words: its number within the chunk, and the fingerprint."""
    own, w = c.owner(), c.words()
    if not len(w):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    order = np.lexsort((w, own))
    own, w = own[order], w[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (w[1:] != w[:-1])
    begin = np.flatnonzero(new)
    weight = np.frexp(np.diff(np.append(begin, len(w))))[1].astype(np.int32)  # of a count n: 1 + floor(log2(n))
    own, w = own[begin], w[begin]
    texts, first = np.unique(own, return_index=True)
    votes = np.zeros((len(texts), 64), dtype=np.int32)
    step = 1 << 15
    for low in range(0, len(w), step):  # few enough terms at once for the cache
        part = w[low : low + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
        signed = (bits * 2 - 1) * weight[low : low + step, None].astype(np.int8)
        inside = np.searchsorted(first, low, side="right") - 1, np.searchsorted(first, low + len(part), side="left")
        at = np.maximum(first[inside[0] : inside[1]] - low, 0)
        votes[inside[0] : inside[1]] += np.add.reduceat(signed, at, axis=0, dtype=np.int32)
    return texts, np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(text: Column) -> Column:
    """bigint: the fingerprint's 64 bits; null for texts without words."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array) -> pa.Array:
        out, known = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        for c in flat.chunks(x):
            rows, prints = fingerprints(c)
            out[c.rows.start + rows] = prints.view(np.int64)
            known[c.rows.start + rows] = True
        return pa.array(out, mask=~known)

    return run(text.cast("string"))


def tables(radius: int, agree: int = 3) -> list[np.uint64]:
    """The mask of bits of each table's key: ``agree`` of radius + agree blocks."""
    blocks = radius + agree
    if radius < 0 or agree < 1 or blocks > 64:
        raise ValueError("radius must be at least 0, agree at least 1, and both together at most 64")
    if math.comb(blocks, agree) > 1 << 15:
        raise ValueError("this takes over 32,768 tables")
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << j) - 1) ^ ((1 << i) - 1) for i, j in zip(cuts, cuts[1:])]
    return [np.uint64(sum(c)) for c in combinations(masks, agree)]


def close_classes(prints: DataFrame, radius: int = NEAR, agree: int = 3) -> DataFrame:
    """(doc_id, class_id, links) of each document with a link, from rows (doc_id, fingerprint): how many
    other documents are within ``radius`` bits, and the least doc_id that it is connected with."""
    keys = tables(radius, agree)
    known = prints.where("doc_id is not null and fingerprint is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("fingerprint").alias("node"))
    members = table(known.select("node", "doc_id"))  # fingerprints are made once
    found = table(_close(members.df.groupBy("node").agg(F.count(F.lit(1)).alias("weight")), radius, keys))
    out = classes(members.df, found.df)
    for t in (members, found):
        t.drop()
    return out.df


def _close(nodes: DataFrame, radius: int, keys: list[np.uint64]) -> DataFrame:
    """(node, links, root): what each task finds of its fingerprints."""
    n, masks = partitions(nodes.sparkSession), np.array(keys, dtype=np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Gather(n)
        for batch in batches:
            p, w = (batch.column(k).to_numpy().astype(np.int64) for k in range(2))
            for k, mask in enumerate(masks):
                yield from out.add(flat.mix((p.view(np.uint64) & mask) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), table=np.full(len(p), k, np.uint16), bits=p, weight=w)
        yield from out.flush()

    def meet(r: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        bits, weight, table = r["bits"].view(np.uint64), r["weight"], r["table"]
        key = bits & masks[table] if len(table) else bits
        order = np.lexsort((bits, key, table))
        bits, weight, table, key = bits[order], weight[order], table[order], key[order]
        ids, node = np.unique(bits, return_inverse=True)
        links, pairs, waiting = np.zeros(len(ids), dtype=np.int64), [], 0
        at, step = np.arange(len(key)), 0
        while len(at):  # neighbours 1, 2, 3 ... apart, as long as any share a key
            step += 1
            at = at[at + step < len(key)]
            at = at[(key[at] == key[at + step]) & (table[at] == table[at + step])]
            differ = bits[at] ^ bits[at + step]
            near = np.flatnonzero(np.bitwise_count(differ) <= radius)
            if len(near):
                first = np.full(len(near), -1)
                for k in reversed(range(len(masks))):
                    first[differ[near] & masks[k] == 0] = k
                near = near[first == table[at[near]]]
                i, j = at[near], at[near] + step
                np.add.at(links, node[i], weight[j])
                np.add.at(links, node[j], weight[i])
                pairs.append(np.column_stack([bits[i], bits[j]]))
                waiting += len(i)
            if waiting > 1 << 20:  # what is connected is kept as a star
                pairs, waiting = [np.column_stack(least_labels(bits[:0], node[:0], *np.concatenate(pairs).T))], 0
        if pairs:
            name, root = least_labels(bits[:0], node[:0], *np.concatenate(pairs).T)
            yield pa.RecordBatch.from_pydict({"node": name.view(np.int64), "links": links[np.searchsorted(ids, name)], "root": root.view(np.int64)})

    sent = exchange(nodes.select("node", "weight").mapInArrow(send, schema("table", "bits", "weight")), n)
    return per_task(sent, meet, {"table": np.uint16, "bits": np.int64, "weight": np.int64}, "node bigint, links bigint, root bigint")


def close_documents(docs: DataFrame, radius: int = NEAR) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return close_classes(docs.select("doc_id", simhash(F.col("text")).alias("fingerprint")), radius)
