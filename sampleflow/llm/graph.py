"""Connected components of a graph in a DataFrame, and classes of linked documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import Table, table


def components(edges: DataFrame) -> Table:
    """Table of (node, root) for each node of ``edges`` (a bigint, b bigint); root is the least node that it is connected with.

    Alternating star contraction: each round links the larger neighbours of a node, then
    itself and its smaller ones, to the least of them, and the rounds end when every node
    has one edge, to its root. Rounds are written, so a lost executor costs one round. The
    least neighbour is aggregated before it is exchanged, and joined back to the edges, so a
    node with very many neighbours is split by the join. Edges of a node with itself make it
    a node; null ends are left out. Ties can't occur.
    """

    def with_least(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("m")), "a")

    pairs = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a is not null and b is not null")
    start = table(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    have = table(start.df.where("a <> b"))
    while True:
        both = have.df.unionByName(have.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).select("a", "b", F.least("m", "a").alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = with_least(large.where("a <> b").distinct())
        linked = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = table(linked)
        before, have = have, new
        # A forest of stars: every node has one edge, and no root has one.
        many = new.df.groupBy("a").count().where("count > 1").select("a")
        deep = new.df.alias("x").join(new.df.alias("y"), F.col("x.b") == F.col("y.a"), "left_semi").select("x.a")
        done = many.unionByName(deep).isEmpty()
        before.drop()
        if done:
            break
    nodes = start.df.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stars = have.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = table(nodes.join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    have.drop()
    start.drop()
    return out


def least_labels(member: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node, and one node for all that are connected by the groups (ascending numbers) or the edges (a, b), within a task."""
    group = np.concatenate([group, np.repeat(np.arange(len(a)) + (group[-1] + 1 if len(group) else 0), 2)])
    ids, node = np.unique(np.concatenate([member, np.column_stack([a, b]).ravel()]), return_inverse=True)
    label = np.arange(len(ids))
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
    while len(group):  # least label within each group, then within each node
        least = np.minimum.reduceat(label[node], begin)
        before = label.copy()
        np.minimum.at(label, node, least[group])
        label = label[label]
        if np.array_equal(before, label):
            break
    return ids, ids[label]


def classes(members: DataFrame, found: DataFrame) -> Table:
    """Table of (doc_id, class_id, links) of each document with a link. members: (node, doc_id), each pair once; the
    documents of one node are linked with each other. found: (node, links, root), in parts: with how many documents
    of other nodes those of the node are linked, and a node that it is connected with. links are added up; class_id is
    the least doc_id that a document is connected with."""
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = members.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(counts, "node", "left").join(roots.df, "node", "left")
    known = table(known.select("node", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")).where("links > 0"))
    named = known.df.join(known.df.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("node", "class_id", "links")
    out = table(members.join(named, "node").select("doc_id", "class_id", "links"))
    for t in (roots, known):
        t.drop()
    return out
