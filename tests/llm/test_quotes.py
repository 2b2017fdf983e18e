import random

from sampleflow.llm.quotes import normal, order, parse, reply_ordered, units

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_parse_levels():
    text = "Hello\nOn Monday Ann wrote:\n> I said\n>> deep one\n> > deep two\n>\n> again\nbye\n>x"
    own, passages = parse(text)
    assert own == "Hello\nbye"
    assert passages == [(1, ["I said"]), (2, ["deep one", "deep two"]), (1, ["", "again"]), (1, ["x"])]
    assert parse("a > b\n - c ") == ("a > b\n - c ", [])
    assert units("A b\nc\n\nd  E") == {"a b c d e", "a b c", "a b", "c", "d e"} - {"a b c d e"} | {normal("A b\nc\n\nd  E")}


def test_order():
    assert order([-1, 0, 0, 1, 2, 1]) == [0, 1, 3, 5, 2, 4]
    assert order([]) == []


def brute(rows, least=20):
    """(conv, position, turn, text, reply, links) by comparing every passage with every message."""
    key = lambda t: -(1 << 63) if t is None else t
    said = [(c, key(t), units(parse(x)[0])) for c, t, _, x in rows if x and c is not None]
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (key(r[1]), r[2] is not None, r[2] or "", r[3] is not None, parse(r[3])[0] if r[3] else ""))
        replies, links = [], []
        for i, (c, t, _, x) in enumerate(mine):
            own = []
            for k, (level, lines) in enumerate(parse(x)[1] if x else []):
                best = []
                for rank, n in enumerate(normal(y) for y in ("\n".join(lines), *lines)):
                    if not n:
                        continue
                    near = [s[1] for s in said if s[0] == c and s[1] < key(t) and n in s[2]]
                    if near and c is not None:
                        best.append((rank > 0, 0, rank, c, max(near)))
                    far = [s[:2] for s in said if n in s[2]]
                    if far and len(n) >= least and min(far)[0] != c:
                        best.append((rank > 0, 1, rank, *min(far)))
                if best:
                    own.append((k, level, *min(best)[3:]))
            links.append(own)
            here = [x for x in own if x[2] == c and c is not None]
            if here:
                low = min(x[1] for x in here)
                replies.append(max(j for j, r in enumerate(mine) if key(r[1]) == [x for x in here if x[1] == low][-1][3]))
            else:
                replies.append(i - 1)
        places = order(replies)
        if conv is None:
            out += [(None, 0, r[1], parse(r[3])[0] if r[3] else r[3], None, tuple(links[i])) for i, r in enumerate(mine)]
            continue
        at = {i: k for k, i in enumerate(places)}
        out += [(conv, at[i], mine[i][1], parse(mine[i][3])[0] if mine[i][3] else mine[i][3], at[replies[i]] if replies[i] >= 0 else None, tuple(links[i])) for i in places]
    return sorted(out, key=repr)


def found(df):
    key = lambda t: -(1 << 63) if t is None else t
    return sorted(((x.conv_id, x.position, x.turn, x.text, x.reply_position, tuple((k.passage, k.level, k.conv_id, key(k.turn)) for k in x.links)) for x in df.collect()), key=repr)


def quote(text, level=1):
    return "\n".join(">" * level + " " + line for line in text.split("\n"))


def test_rows_are_those_of_brute_force(spark):
    r = random.Random(2)
    rows, texts = [], []
    for conv in range(25):
        before = []
        for turn in range(r.randrange(1, 8)):
            own = "\n".join(r.choice(["", "\n"]).join(f"word{r.randrange(9999)} and more of it {r.randrange(99)}\n" for _ in range(r.randrange(1, 3))).strip() for _ in range(2))
            parts = [own]
            for _ in range(r.randrange(3)):
                source = r.choice(before + texts[-3:]) if before and r.random() < 0.8 else r.choice(texts or ["nothing like it"])
                source = parse(source)[0]
                piece = r.choice([source, source.split("\n")[0], source.split("\n\n")[-1], "lost words\n" + source.split("\n")[-1]])
                parts.insert(r.randrange(len(parts) + 1), ("Bob wrote:\n" if r.random() < 0.5 else "") + quote(piece.upper() if r.random() < 0.2 else piece, r.randrange(1, 3)))
            text = "\n".join(parts)
            rows.append((conv, turn, r.choice(["user", "assistant"]), text))
            before.append(text)
            texts.append(text)
    rows += [(3, None, "user", "early words that are long enough"), (3, 9, None, quote("early words that are long enough")), (4, 0, "user", None), (4, 1, "user", ""), (None, 1, "user", quote(texts[0].split("\n")[-1]) + "\nx"), (None, 1, "user", "y")]
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], SCHEMA + ", position int, own string")
    want = brute(rows)
    assert found(reply_ordered(docs)) == want
    assert sum(len(x[5]) for x in want) > 30 and any(k[2] != x[0] for x in want for k in x[5])


def test_repeated_rows_empty_and_long(spark):
    rows = [(1, 0, "user", "a question"), (1, 0, "user", "a question"), (1, 1, "assistant", "> a question\nyes"), (1, 2, "user", "> a question\nno\n" + "long " * 300_000)]
    out = {(x.position, x.turn, x.reply_position) for x in reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {(0, 0, None), (1, 0, 0), (2, 1, 1), (3, 2, 1)}
    assert reply_ordered(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rewrapped_paragraphs_and_other_conversations(spark):
    said = "Opening words.\n\nA paragraph that was\nwrapped one way here.\n\nClosing words."
    passage = "a passage that two conversations say"
    rows = [
        (1, 0, "user", said),
        (1, 1, "assistant", "> A paragraph\n> that was wrapped one way\n> here.\n>\n> not said\nyes"),
        (2, 0, "user", quote(passage)),  # its own conversation says so only later
        (2, 1, "user", passage),
        (3, 4, "user", passage),
        (5, 2, "user", passage),
    ]
    got = {(x.conv_id, x.turn): [(k.conv_id, k.turn) for k in x.links] for x in reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0): [], (1, 1): [(1, 0)], (2, 0): [(3, 4)], (2, 1): [], (3, 4): [], (5, 2): []}


def test_messages_without_a_conversation_are_spread(spark):
    rows = [(None, i, "user", f"message {i}") for i in range(400)] + [(1, 0, "user", "hello there"), (1, 1, "user", "> hello there\nyes")]
    out = reply_ordered(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    sizes = [len(p) for p in out.rdd.glom().collect()]
    assert sum(sizes) == 402 and max(sizes) < 300


def test_a_long_line_before_a_quotation_goes_with_it():
    own, passages = parse("x" * 5000 + " wrote:\n> a\nb")
    assert own == "b" and passages == [(1, ["a"])]
