"""Conversations in reply order, with quoted passages linked to what they quote.

Lines that begin with ">" marks, spaces between them or not, are quoted at the level
of their number of marks; neighbouring lines of a level are a passage, and a line that
only says who wrote what follows ("... wrote:") goes with it. Passages are normalised (no marks,
lower case, white space as one space) and hashed. They are joined with the hashes of
what messages say themselves: their whole text, their paragraphs and their lines. A
passage is first looked up whole, then by the first of its lines that is found, then by
the first of its paragraphs; in its own conversation, where the latest earlier message
counts, then, if it has ``least`` characters, in all others, where the first by
(conv_id, turn) counts.

A message replies to the message quoted by the last of its passages of the least
level that is linked within the conversation, else to the message before it. A
conversation's rows are ordered by replies: each message, then its replies by turn.

Defined cases: a null or empty text stays as it is and quotes nothing; a null turn comes
before all others; messages of one turn are ordered by role, then text, nulls first.
A null conv_id has no conversation: each such message is position 0, and replies to
none. Repeated rows are messages of their own. Very long texts are taken whole. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import partitions

_MARKS = regex.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$", regex.S)
_WROTE = regex.compile(r"^[ \t]*\S.*\b(?:wrote|writes|schrieb|a écrit|escribió)[ \t]?:[ \t]*$", regex.I)
_BLANK = regex.compile(r"\n[ \t]*\n")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """A message's own text, and its quoted passages (level, lines) in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    inside = False
    for line in text.split("\n"):
        found = _MARKS.match(line)
        if found:
            level = found[1].count(">")
            if not inside and own and _WROTE.match(own[-1]):
                own.pop()
            if inside and passages[-1][0] == level:
                passages[-1][1].append(found[2])
            else:
                passages.append((level, [found[2]]))
            inside = True
        else:
            own.append(line)
            inside = False
    return ("\n".join(own).strip() if passages else text), passages


def units(own: str) -> set[str]:
    """What a quotation of this text may be: all of it, a paragraph, or a line; normalised."""
    return {n for part in (own, *_BLANK.split(own), *own.split("\n")) if (n := normal(part))}


def wanted_of(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """(kind, rank, normalised text) of all that a passage is looked up by."""
    whole = "\n".join(lines)
    for kind, parts in enumerate(([whole], lines, _BLANK.split(whole))):
        yield from ((kind, r, n) for r, x in enumerate(parts) if (n := normal(x)))


def order(replies: list[int]) -> list[int]:
    """Each message, then its replies; replies[i] < i is what i replies to, or -1."""
    children: list[list[int]] = [[] for _ in replies]
    roots = []
    for i, r in enumerate(replies):
        (children[r] if r >= 0 else roots).append(i)
    out, work = [], roots[::-1]
    while work:
        i = work.pop()
        out.append(i)
        work += children[i][::-1]
    return out


_ROW = "conv_id bigint, turn bigint, role string, text string, own string"


def _parsed(messages: DataFrame) -> DataFrame:
    """The messages with their own text; ``says``, hashes of its units; ``quotes``, of each passage, its lines and its paragraphs (by ``kind`` 0, 1, 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("kind", pa.int32()), ("rank", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())]))
        for batch in batches:
            own, says, quotes = [], [], []
            for text in batch.column(3).to_pylist():
                mine, passages = parse(text) if text else (text, [])
                own.append(mine)
                says.append([hashed(u) for u in units(mine)] if mine else [])
                quotes.append([{"passage": k, "level": level, "kind": kind_of, "rank": r, "hash": hashed(n), "size": len(n)} for k, (level, lines) in enumerate(passages) for kind_of, r, n in wanted_of(lines)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string()), pa.array(says, pa.list_(pa.int64())), pa.array(quotes, kind)], names=["conv_id", "turn", "role", "text", "own", "says", "quotes"])

    chosen = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, _ROW + ", says array<bigint>, quotes array<struct<passage:int,level:int,kind:int,rank:int,hash:bigint,size:int>>")


_LINK = "struct<passage:int,level:int,conv_id:bigint,turn:bigint>"
_NO_TURN = -(1 << 63)


def reply_ordered(messages: DataFrame, least: int = 20) -> DataFrame:
    """(conv_id, position, turn, role, text, reply_position, links): each message without its quotes; links
    are (passage, level, conv_id, turn) of what its passages quote, reply_position is the place of what it replies to."""
    rows = _parsed(messages)
    turn = F.coalesce("turn", F.lit(_NO_TURN)).alias("turn")
    quoted = rows.where("size(quotes) > 0").select("conv_id", turn, F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    said = rows.where("conv_id is not null").select("conv_id", turn, F.explode("says").alias("hash"))
    near = quoted.join(said.withColumnRenamed("turn", "there"), ["conv_id", "hash"]).where("there < turn")
    near = near.groupBy("conv_id", "turn", "passage", "level", "kind", "rank").agg(F.max("there").alias("there")).select("*", F.col("conv_id").alias("conv"), F.lit(0).alias("far"))
    wanted = quoted.where(F.col("size") >= least).withColumnRenamed("conv_id", "from")
    first = said.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("m"))
    held = wanted.join(first, "hash")
    mine = held.where("m.conv_id = from")
    # Where the own conversation is the first, the first of the others counts.
    second = said.join(mine.select("hash", F.col("from").alias("own")).distinct(), "hash").where("conv_id <> own").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("m"))
    far = held.where("m.conv_id <> from or from is null").unionByName(mine.drop("m").join(second, "hash"))
    far = far.select(F.col("from").alias("conv_id"), "turn", "passage", "level", "kind", "rank", F.col("m.turn").alias("there"), F.col("m.conv_id").alias("conv"), F.lit(1).alias("far"))
    # of a passage: whole before lines before paragraphs, the own conversation before others
    links = near.unionByName(far).groupBy("conv_id", "turn", "passage", "level").agg(F.min(F.struct("kind", "far", "rank", "conv", "there")).alias("m"))
    links = links.select("conv_id", "turn", F.struct("passage", "level", F.col("m.conv").alias("conv_id"), F.col("m.there").alias("turn")).alias("l"))
    links = links.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("l")).alias("links"))
    have = rows.select("conv_id", "turn", "role", "own", F.expr("transform(quotes, q -> q.passage)").alias("own_passages"), turn.alias("at"))
    with_links = have.join(links.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "links"), F.expr("conv_id <=> c and at = t"), "left")
    # messages of one turn may quote different passages: each keeps the links of those it has
    with_links = with_links.select("conv_id", "turn", "role", "own", F.expr("filter(coalesce(links, array()), l -> array_contains(own_passages, l.passage))").alias("links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_pylist(list(_placed(held)), schema=_SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conv_id"] is None or row["conv_id"] != held[0]["conv_id"]):
                    yield from done()
                    held = []
                held.append(row)
        yield from done()

    # One task holds one conversation at a time; those without a conv_id go anywhere.
    spread = with_links.repartition(partitions(messages.sparkSession), F.when(F.col("conv_id").isNull(), F.xxhash64("own", "turn")).otherwise(F.xxhash64("conv_id")), F.col("conv_id"))
    return spread.sortWithinPartitions("conv_id", "turn", "role", "own").mapInArrow(run, f"conv_id bigint, position int, turn bigint, role string, text string, reply_position int, links array<{_LINK}>")


_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("position", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("reply_position", pa.int32()),
        ("links", pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("conv_id", pa.int64()), ("turn", pa.int64())]))),
    ]
)


def _placed(rows: list[dict]) -> Iterator[dict]:
    """The messages of a conversation, ordered by turn, in reply order."""
    last = {_NO_TURN if r["turn"] is None else r["turn"]: i for i, r in enumerate(rows)}
    replies = []
    for i, r in enumerate(rows):
        here = [x for x in r["links"] if x["conv_id"] == r["conv_id"]]
        if here:
            level = min(x["level"] for x in here)
            replies.append(last[[x for x in here if x["level"] == level][-1]["turn"]])
        else:
            replies.append(i - 1)
    places = order(replies)
    position = {i: k for k, i in enumerate(places)}
    for i in places:
        r = rows[i]
        for x in r["links"]:
            x["turn"] = None if x["turn"] == _NO_TURN else x["turn"]
        yield {"conv_id": r["conv_id"], "position": position[i], "turn": r["turn"], "role": r["role"], "text": r["own"], "reply_position": position[replies[i]] if replies[i] >= 0 else None, "links": r["links"]}
