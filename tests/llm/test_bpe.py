import base64

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sampleflow.llm import bpe
from sampleflow.llm.bpe import decoded, encoded, vocabulary

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def agree(library, texts):
    v = vocabulary(PATH)
    ids = v.encode(pa.array(texts, pa.string()))
    for text, got in zip(texts, ids.to_pylist()):
        assert got == (None if text is None else library.encode_ordinary(text)), repr(text)
    assert v.decode(ids).to_pylist() == texts
    both = v.encode_exact(pa.array(texts, pa.string()))
    assert both.field("tokens").to_pylist() == ids.to_pylist() and both.field("exact").to_pylist() == [None if t is None else True for t in texts]


CASES = [
    "", None, " ", "  ", "a", "a b", "a  b", "a \n b\n\n", "\n", " \n", "it's we'll they've I'm he'd won't you're 's's 'sx 'll'd''s '' 's",
    "a'", "'", "' s", "x 's", "'re", "'r", "'l l", "12 3a4", "héllo 中文 \U0001f600\U0001f600   　x", "aaaaaaaaaaaaa", "  !!??  ..\t\tz ", "<|endoftext|>",
    "o'", "re", "'t", "t",
]


def test_cases_in_one_batch_are_those_of_the_library(library):
    agree(library, CASES)
    agree(library, CASES[::-1])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n'srtlvemdaAx1.! é"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_any_text(library, texts):
    agree(library, texts)


def test_long_piece_and_small_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "CHUNK", 200)
    rng = np.random.default_rng(0)
    agree(library, ["".join(rng.choice(list("abcdehr"), 5000)), "ab" * 3000, *(" ".join("".join(rng.choice(list("xyzt"), 5)) for _ in range(50)) for _ in range(20))])


def test_column_functions(spark, library):
    texts = ["some text", "", None, "x " * 200_000, "some text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = df.select("doc_id", "text", encoded(df.text, PATH).alias("ids")).withColumn("back", decoded(__import__("pyspark").sql.functions.col("ids"), PATH)).orderBy("doc_id").collect()
    assert [r.back for r in out] == texts
    assert [r.ids for r in out] == [None if t is None else library.encode_ordinary(t) for t in texts]
    odd = spark.createDataFrame([(1, [1, None]), (2, [-1]), (3, [50256]), (4, [10**9]), (5, None), (6, [])], "k int, ids array<bigint>")
    assert [r[0] for r in odd.select(decoded(odd.ids, PATH)).collect()] == [None] * 5 + [""]
    assert df.where("doc_id < 0").select(encoded(df.text, PATH)).collect() == []
