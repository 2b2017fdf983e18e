"""Literal cases and small models of every operator, resuming, sources without an end, and files."""

import functools
import gzip
import itertools
import json
import random
import struct
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sampleflow.dataset import concat_datasets, from_df, from_files, from_iterable, from_mds, from_sequence, interleave_datasets
from sampleflow.functions import hex_bytes
from sampleflow.operators.combine import slots
from sampleflow.operators.ordering import buffer_order
from sampleflow.operators.tokens import packs
from sampleflow.order import POS, from_keys
from sampleflow.sources import shards
from sampleflow.sources.shards import epoch_orders, expand_braces, format_of, jsonl_rows, segments
from sampleflow.tokenizers import BytesTokenizer

COUNTS = [5, 3, 20, 4, 0, 5]


def ids(n, **kw):
    return from_sequence([{"id": i} for i in range(n)], **kw)


def column(d, c="id", n=None):
    return [r[c] for r in itertools.islice(d.iterate(), n)]


def tokens_of(*lengths):
    out, at = [], 0
    for n in lengths:
        out.append({"input_ids": list(range(at, at + n))})
        at += n
    return out


def test_rows_and_order(spark):
    d = ids(20)
    assert column(d.map({"id": F.col("id") * 2})) == list(range(0, 40, 2))
    assert column(d.map(lambda r: {"id": r["id"] * 2})) == list(range(0, 40, 2))
    assert column(d.filter("id % 2 = 0")) == column(d.filter(lambda r: r["id"] % 2 == 0)) == list(range(0, 20, 2))
    assert column(d.filter_map(lambda r: {"id": r["id"] * 3} if r["id"] % 2 == 0 else None)) == list(range(0, 60, 6))
    assert column(d.filter("id % 2 = 0").enumerate(), "step") == list(range(10))
    assert column(d.take(5)) == [0, 1, 2, 3, 4] and column(d.take(0)) == []
    for interval, offset in ((1, 0), (2, 1), (5, 4), (100, 99)):
        assert column(d.stride(interval, offset)) == list(range(20))[offset::interval]
    assert column(d.batch(3, drop_last=True)) == [[i, i + 1, i + 2] for i in range(0, 18, 3)]
    assert column(d.batch(3))[-1] == [18, 19]
    assert "step" not in d.enumerate("").to_df().columns


def test_arguments_are_checked(spark):
    d = ids(3)
    for bad in (lambda: d.stride(2, 2), lambda: d.batch(0), lambda: d.shuffle(0), lambda: d.chunk(0).to_df(), lambda: concat_datasets([]), lambda: interleave_datasets([d], [0.0]), lambda: interleave_datasets([d], [1, 1]), lambda: d.parallel_map(dict, max_workers=0), lambda: ids(3, repeat=True).to_df(), lambda: from_sequence([], repeat=True), lambda: format_of("x.txt"), lambda: d.pad({"none": 0}, 4).to_df()):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="must not return None"):
        list(d.parallel_map(lambda r: None, "id bigint"))


def test_shuffles(spark):
    assert column(ids(10).shuffle(4)) == [0, 3, 2, 1, 6, 7, 4, 5, 9, 8]
    assert column(ids(10).shuffle(1)) == list(range(10))
    assert sorted(buffer_order(50, 7, 1)) == list(range(50))
    assert column(ids(5, shuffle=True, repeat=True), n=10) == [3, 1, 2, 4, 0, 4, 2, 3, 0, 1]
    whole = column(ids(9, repeat=True).take(90).shuffle(4))
    assert column(ids(9, repeat=True).shuffle(4), n=40) == whole[:40]


@pytest.mark.parametrize("k", [0, 1, 10, 13])
def test_resuming_goes_on_where_it_stopped(spark, k):
    for d in (ids(7, repeat=True).filter("id % 3 > 0"), ids(40).shuffle(6).batch(2), interleave_datasets([ids(30), ids(30, repeat=True)], [1, 2], 8)):
        with d.iterate(window=8) as it:
            for _ in range(k):
                next(it)
            state = it.state_dict()
            rest = list(itertools.islice(it, 5))
        assert list(itertools.islice(d.iterate(state), 5)) == rest
        assert state == d.state(k)
    with pytest.raises(ValueError):
        ids(8).iterate(ids(7).state(1))


def test_chunks(spark):
    d = from_sequence(tokens_of(6, 8, 3, 9))
    assert column(d.chunk(4), "input_ids") == [[0, 1, 2, 3], [6, 7, 8, 9], [10, 11, 12, 13], [17, 18, 19, 20], [21, 22, 23, 24]]
    assert [len(x) for x in column(d.chunk(4, drop_remainder=False), "input_ids")] == [4, 2, 4, 4, 3, 4, 4, 1]
    e = from_sequence([{"input_ids": [0, 1, 2]}, {"input_ids": [3]}, {"input_ids": list(range(4, 12))}])
    assert column(e.add_bos_eos(-1, -2).concat_chunk(4), "input_ids") == [[-1, 0, 1, 2], [-2, -1, 3, -2], [-1, 4, 5, 6], [7, 8, 9, 10]]
    e = e + from_sequence([{"input_ids": []}])
    assert column(e.filter("size(input_ids) < 4").pad({"input_ids": 9}, 3), "input_ids") == [[0, 1, 2], [3, 9, 9], [9, 9, 9]]
    with pytest.raises(Exception, match="don't fit"):
        list(e.pad({"input_ids": 9}, 3))


def test_packs(spark):
    lengths = [2, 1, 8, 3, 3, 1, 1, 1, 1, 1]
    rows = [{"input_ids": [i] * n} for i, n in enumerate(lengths)]
    d = from_sequence(rows)
    want = [[0, 0, 1], [2] * 4, [3] * 3, [4, 4, 4, 5], [6, 7, 8, 9]]
    assert column(d.pack_chunk(4, ("input_ids",)), "input_ids") == want
    assert column(d.pack_chunk(4, ("input_ids",), discard_long_samples=True), "input_ids") == [want[0], *want[2:]]
    long_first = from_sequence([{"input_ids": [7] * 8}, {"input_ids": [1]}])
    assert column(long_first.pack_chunk(4, ("input_ids",)), "input_ids") == [[], [7] * 4, [1]]
    assert list(packs(iter([]), 4, False)) == []


def test_packs_and_concatenations_are_those_of_models(spark):
    r = random.Random(3)
    rows = [{"input_ids": [r.randrange(9) for _ in range(r.randrange(12))]} for _ in range(200)]
    flat = [t for x in rows for t in x["input_ids"]]
    assert column(from_sequence(rows).concat_chunk(7), "input_ids") == [flat[i : i + 7] for i in range(0, len(flat) // 7 * 7, 7)]
    out, pack = [], []
    for x in rows:
        if len(pack) + len(x["input_ids"]) > 10:
            out.append(pack[:10])
            pack = []
        pack = pack + x["input_ids"]
    out += [pack[:10]] * bool(pack)
    assert column(from_sequence(rows).pack_chunk(10, ("input_ids",)), "input_ids") == out


def test_several(spark):
    a, b = (from_sequence([{"data": n, "value": i} for i in range(3)]) for n in "ab")
    b = b.map({"value": F.col("value") + 3})
    assert column(a + b, "value") == [0, 1, 2, 3, 4, 5]
    assert column(interleave_datasets([a, b]), "value") == [0, 3, 1, 4, 2, 5]
    assert slots([1, 2], 9)[0] == [1, 4, 7]
    assert column(ids(2) + ids(3, repeat=True), n=7) == [0, 1, 0, 1, 2, 0, 1]
    assert column(interleave_datasets([ids(3), ids(2, repeat=True)], [1, 0])) == [0, 1, 2]


def test_iterables_cache_and_tokenizers(spark):
    assert column(from_iterable([{"id": i} for i in range(3)], repeat=True), n=7) == [0, 1, 2, 0, 1, 2, 0]

    class Endless:
        def __iter__(self):
            return ({"id": i} for i in itertools.count())

    assert column(from_iterable(Endless(), endless=True).batch(2), n=2) == [[0, 1], [2, 3]]
    cached = ids(4).cache()
    assert column(cached) == column(cached) == [0, 1, 2, 3]
    texts = from_sequence([{"text": "ab", "k": 1}, {"text": "", "k": 2}])
    encoded = texts.tokenize(BytesTokenizer(), schema="text string, k bigint, input_ids array<bigint>")
    assert column(encoded, "input_ids") == [[97, 98], []] and column(encoded, "k") == [1, 2]
    for begins, ends, want in ((False, False, [256, 97, 98, 257]), (True, False, [97, 98, 257]), (False, True, [256, 97, 98]), (True, True, [97, 98])):
        assert column(encoded.ensure_bos_eos(BytesTokenizer(begins, ends)), "input_ids")[0] == want
    same = BytesTokenizer()
    same.bos_token_id = same.eos_token_id = 300
    assert column(encoded.ensure_bos_eos(same), "input_ids")[0] == [97, 98, 300]


def test_nulls_empty_tables_and_repeated_keys(spark):
    df = spark.createDataFrame([(3, "c"), (None, "n"), (1, "a"), (1, "b")], "k bigint, v string")
    assert column(from_df(df, "k", "v"), "v") == ["n", "a", "b", "c"]
    empty = from_df(spark.createDataFrame([], "k bigint, input_ids array<bigint>"), "k")
    for d in (empty, empty.shuffle(3), empty.batch(2), empty.concat_chunk(2), empty.pack_chunk(2, ("input_ids",)), empty.chunk(2), empty + empty, interleave_datasets([empty, empty])):
        assert list(d) == []
    tokens = from_df(spark.createDataFrame([(1, None), (2, [5])], "k bigint, input_ids array<int>"), "k")
    assert column(tokens.add_bos_eos(0, None), "input_ids") == [[0], [0, 5]]


def mux(counts, active, epochs=1):
    out = []
    for _ in range(epochs):
        waiting, live = list(range(len(counts))), []
        while True:
            while len(live) < min(active, len(counts)) and waiting:
                live.append([waiting.pop(0), 0])
            if not live:
                break
            s = live.pop(0)
            if s[1] < counts[s[0]]:
                out.append((s[0], s[1]))
                live.append([s[0], s[1] + 1])
    return out


def test_merged_order_is_that_of_the_model():
    r = random.Random(5)
    for _ in range(300):
        counts = [r.choice([0, 1, 2, 3, 9, 30]) for _ in range(r.randrange(1, 9))]
        active, epochs = r.randrange(1, 6), r.randrange(1, 3)
        placed = {}
        for shard, low, high, at, step in segments(counts, epoch_orders(len(counts), epochs, False, 0), active):
            for k in range(high - low):
                assert placed.setdefault(at + k * step, (shard, low + k)) == (shard, low + k)
        assert [placed[k] for k in range(len(placed))] == mux(counts, active, epochs)


def cbor_item(x):
    if isinstance(x, dict):
        return bytes([0xA0 + len(x)]) + b"".join(cbor_item(k) + cbor_item(v) for k, v in x.items())
    if isinstance(x, str):
        raw = x.encode()
        return (bytes([0x60 + len(raw)]) if len(raw) < 24 else b"\x78" + bytes([len(raw)])) + raw
    return bytes([x]) if x < 24 else b"\x18" + bytes([x])


@pytest.mark.parametrize("kind", ["jsonl", "cbor", "jsonl.gz"])
def test_files(spark, tmp_path, kind):
    for f, n in enumerate(COUNTS):
        rows = [{"text": f"row {i}", "file_index": f} for i in range(n)]
        raw = b"".join(map(cbor_item, rows)) if kind == "cbor" else "".join(json.dumps(x) + "\n\n" for x in rows).encode()
        (tmp_path / f"{f}.{kind}").write_bytes(gzip.compress(raw) if kind.endswith("gz") else raw)
    pattern = str(tmp_path) + "/{0..5}." + kind
    want = [s for s, _ in mux(COUNTS, 2)]
    assert column(from_files(pattern, n_active_shards=2), "file_index") == want
    if kind == "jsonl":
        assert column(from_files(pattern, n_active_shards=2, repeat=True), "file_index", 50) == (want * 2)[:50]
        mixed = column(from_files(pattern, shuffle_shards=True), "file_index")
        assert sorted(mixed) == sorted(want)


def test_lines_and_names():
    assert list(jsonl_rows([b'{"a":1}\n', b"\n", b"{'a':1}\n", b"[1]\n", b"null\n", b'{"a":2} x\n', b'{"a":3}\n'])) == [{"a": 1}, {"a": 3}]
    with pytest.raises(ValueError):
        list(jsonl_rows([b"x\n"] * 10))
    assert expand_braces("s{01..03}-{a,b}") == ["s01-a", "s01-b", "s02-a", "s02-b", "s03-a", "s03-b"]
    assert format_of("X.JSONL.zst") == "jsonl" and format_of("x", "CBOR") == "cbor"


def test_mds(spark, tmp_path):
    def sample(i, t):
        raw = t.encode()
        return struct.pack("<I", len(raw)) + struct.pack("<q", i) + raw

    shards = []
    for f, rows in enumerate(([(0, "a"), (1, "bc")], [(2, "")])):
        body = [sample(*x) for x in rows]
        at = [4 + 4 * (len(body) + 1)]
        for b in body:
            at.append(at[-1] + len(b))
        (tmp_path / f"{f}.mds").write_bytes(struct.pack(f"<{len(at) + 1}I", len(body), *at) + b"".join(body))
        shards.append({"column_names": ["id", "text"], "column_encodings": ["int", "str"], "column_sizes": [8, None], "raw_data": {"basename": f"{f}.mds"}, "compression": None, "samples": len(body)})
    (tmp_path / "index.json").write_text(json.dumps({"shards": shards, "version": 2}))
    d = from_mds(str(tmp_path))
    assert column(d) == [0, 1, 2] and column(d, "text") == ["a", "bc", ""]
    assert column(from_mds(str(tmp_path), repeat=True), n=5) == [0, 1, 2, 0, 1]
    assert POS in d.to_df().columns


def test_keys_over_the_whole_range(spark):
    low, high = -(2**63), 2**63 - 1
    for keys in ([low, 5, high], [low, low + 1, low + 2, None, None], [high, high - 1, high, 0], [None], [], [-3, -1, 0, 1, 3, None]):
        df = from_keys(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k")
        found = [(r[POS], r.k) for r in df.orderBy(POS).collect()]
        assert found == list(enumerate(sorted(keys, key=lambda k: (k is not None, k or 0)))), keys
    many = [random.Random(7).randrange(low, high) for _ in range(3000)]
    assert [r.k for r in from_keys(spark.createDataFrame([(k,) for k in many], "k bigint"), "k").orderBy(POS).collect()] == sorted(many)


def test_a_key_that_occurs_late_is_not_lost(spark):
    def late(r):
        return {"id": r["id"], "deep": {"a": 1, **({"b": 2} if r["id"] == 150 else {})}}

    with pytest.raises(Exception, match="deep.b isn't among"):
        column(ids(200).map(late))
    with pytest.raises(Exception, match="extra isn't among"):
        column(ids(20).batch(5, collate_fn=lambda rows: {"n": len(rows), **({"extra": 1} if rows[0]["id"] else {})}), "n")
    given = ids(200).map(late, "id bigint, deep struct<a: bigint, b: bigint>")
    assert [r["deep"]["b"] for r in given] == [2 if i == 150 else None for i in range(200)]
    assert column(ids(200).map(late, "id bigint")) == list(range(200))  # what a given schema leaves out goes


def scaled(k):
    return lambda r: {"id": r["id"] * k}


def test_plans_that_differ_have_unlike_states(spark):
    d = ids(4)
    plans = [d.map({"id": F.col("id") * 2}), d.map({"id": F.col("id") * 3}), d.map({"id": "id * 2"}), d.map(scaled(2)), d.map(scaled(3)),
             d.map(lambda r: {"id": r["id"] + 1}), d.map(lambda r: {"id": r["id"] + 2}), d.filter(F.col("id") > 1), d.filter(F.col("id") > 2),
             d.filter(lambda r: r["id"] in {1, 2}), d.filter(lambda r: r["id"] in {1, 3}), d.map(functools.partial(dict, a=1)), d.map(functools.partial(dict, a=2)),
             d.tokenize(BytesTokenizer()), d.tokenize(BytesTokenizer(begins=True)), d.tokenize(BytesTokenizer(), {"a": 1})]
    assert len({p.state(0)["plan"] for p in plans}) == len(plans)
    assert d.map(scaled(2)).state(0) == plans[3].state(0)
    assert d.tokenize(BytesTokenizer()).state(0) == plans[13].state(0)
    with pytest.raises(ValueError):
        plans[0].iterate(plans[1].state(1))


def test_a_shard_whose_connection_drops_is_read_on(monkeypatch):
    body = b"".join(b'{"id": %d}\n' % i for i in range(2000))
    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            if self.path == "/none.jsonl" or len(asked) == 2:
                self.send_error(404 if self.path == "/none.jsonl" else 503)
                return
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body if len(asked) == 4 else body[: 8000 * len(asked)])

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(shards, "FIRST_WAIT", 0.0)
    monkeypatch.setenv("SAMPLEFLOW_OPEN_DELAY_HTTP", "0")
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        cut = at + "/a.jsonl"
        assert [r["id"] for r in shards.steady_rows(cut, "jsonl")] == list(range(2000)) and len(asked) == 4
        with pytest.raises(OSError):
            list(shards.steady_rows(at + "/none.jsonl", "jsonl"))
        assert len(asked) == 5  # what isn't there is asked for once
    finally:
        server.shutdown()


def test_shards_that_fail_for_good(tmp_path, monkeypatch):
    tries = []
    monkeypatch.setattr(shards, "FIRST_WAIT", 0.0)
    monkeypatch.setattr(shards, "opened", lambda url: tries.append(url) or (_ for _ in ()).throw(ConnectionError("gone")))
    with pytest.raises(ConnectionError):
        list(shards.steady_rows("x.jsonl", "jsonl"))
    assert len(tries) == shards.TRIES


def test_bytes_of_long_texts(spark):
    """The work grows as the text: taking every byte from the whole text again took over 100 s here."""
    odd = ["", None, "\x00a\x7f\x80\xff", "é日本語😀", "á\r\n\t ", "".join(map(chr, range(0x900)))]
    long = "añ😀b" * 12_500
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, long])], "i int, text string").select("i", hex_bytes(F.col("text")).alias("ids"))
    df.where("i = 0").collect()  # starts what Spark needs
    began = time.perf_counter()
    got = {r.i: r.ids for r in df.collect()}
    assert time.perf_counter() - began < 20
    assert [got[i] for i in range(len(got))] == [list((t or "").encode()) for t in [*odd, long]]
