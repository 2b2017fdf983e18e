import math
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa

from sampleflow.llm import flat
from sampleflow.llm.language import address, declared, likelihoods, page_languages, train, trigrams, visible

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
SYLLABLES = {"aa": "ka lo mi ta ren".split(), "bb": "sch ung ber ein lich".split()}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def documents(r, n=120):
    return [(i, text(r, lang, 60), lang, "s", 0) for i in range(n) for lang in [r.choice(["aa", "bb"])]]


def test_parts_of_a_page():
    page = "<html  class=x lang='EN-us'><head><script>var t='</p>'; sch</script><STYLE>b</STYLE></head><!-- c > --><p>a&amp;b<br>c</p><script>open"
    assert visible(page).split() == ["a&b", "c"] and declared(page) == "en" and declared("<p lang=de>") == ""
    assert address("https://Blog.x.example.org:80/a?b") == ("blog.x.example.org", "example.org", "org")
    assert address(None) == address("nonsense") == address("http://[bad") == ("", "", "")
    (c,) = flat.chunks(pa.array(["Ab \n c", "", "xy", None, "xyz"]))
    own, grams = trigrams(c)
    assert own.tolist() == [0, 0, 4] and len(set(grams.tolist())) == 3


def test_likelihoods_are_sums(spark):
    r = random.Random(0)
    langs, model = train(spark.createDataFrame(documents(r), DOCS))
    assert langs == ["aa", "bb"] and np.allclose(np.exp(model).sum(axis=0), 1)
    texts = [text(r, "aa", 20), "", text(r, "bb", 5), None, "x"]
    got = likelihoods(pa.array(texts), model)
    for row, t in zip(got, texts):
        b = (t or "").lower().encode()
        b = bytes(32 if x < 32 else x for x in b)
        codes = [((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(b) - 2)]
        assert np.allclose(row, [sum(model[c, k] for c in codes) for k in range(2)])


def make_pages(r):
    pages, truth = [], {}
    hosts = {"aa": ["www.one.example.org", "m.one.example.org"], "bb": ["two.example.net", "blog.three.example.zz"]}
    for i in range(300):
        lang = r.choice(["aa", "bb"])
        said = lang if r.random() < 0.8 else r.choice(["aa", "bb", ""])
        n = r.choice([0, 1, 3, 80])
        pages.append((i, f"http://{r.choice(hosts[lang])}/{i}", f"<html lang='{said}'><p>{text(r, lang, n)}</p></html>"))
        truth[i] = lang
    return pages, truth


def brute(pages, langs, model, temper=0.05, hw=5.0, dw=10.0, s=1.0):
    rows = []
    for _, url, page in pages:
        page = page or ""
        ll = temper * likelihoods(pa.array([visible(page)]), model)[0]
        p = np.exp(ll - ll.max())
        rows.append((*address(url), declared(page), ll, p / p.sum()))
    sums = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(4)]
    total = sum(x[5] for x in rows)
    for x in rows:
        for k in range(4):
            sums[k][x[k]] += x[5]
    out = []
    for x in rows:
        root = (total + s) / (total.sum() + s * len(langs))
        own = [np.maximum(sums[k][x[k]] - x[5], 0) for k in range(4)]
        domain = (own[1] + dw * root) / (own[1].sum() + dw)
        host = (own[0] + hw * domain) / (own[0].sum() + hw)
        odds = x[4] + np.log(host) + np.log((own[2] + s) / (total + s * len(sums[2]))) + np.log((own[3] + s) / (total + s * len(sums[3])))
        odds = np.exp(odds - odds.max())
        out.append((langs[int(odds.argmax())], odds.max() / odds.sum()))
    return out


def test_fusion_is_that_of_brute_force_and_accurate(spark):
    r = random.Random(7)
    docs = spark.createDataFrame(documents(r), DOCS)
    pages, truth = make_pages(r)
    odd = [(1000, None, None), (1001, "", ""), (None, "http://x", "<p>ka lo"), pages[0], pages[0]]
    have = spark.createDataFrame([(*p, "a", 1) for p in pages + odd], PAGES + ", host string, p_0 int")
    got = page_languages(spark, docs, have).collect()
    assert len(got) == len(pages) + len(odd)
    langs, model = train(docs)
    want = sorted((str(p[0]), lang, round(x, 6)) for p, (lang, x) in zip(pages + odd, brute(pages + odd, langs, model)))
    assert sorted((str(x.page_id), x.lang, round(x.probability, 6)) for x in got) == want
    assert np.mean([x.lang == truth[x.page_id] for x in got if x.page_id in truth]) > 0.95
    texts = np.mean([x.text_lang == truth[x.page_id] for x in got if x.page_id in truth])
    assert texts < np.mean([x.lang == truth[x.page_id] for x in got if x.page_id in truth])


def test_empty_tables_and_long_pages(spark):
    r = random.Random(1)
    docs, none = spark.createDataFrame(documents(r), DOCS), spark.createDataFrame([], DOCS)
    long = spark.createDataFrame([(1, "http://a.b", "<html>" + text(r, "bb", 300_000))], PAGES)
    (x,) = page_languages(spark, docs, long).collect()
    assert x.lang == "bb" and math.isclose(x.probability, 1)
    assert page_languages(spark, none, long).collect()[0].lang is None
    assert page_languages(spark, docs, long.where("page_id < 0")).collect() == []


def test_odd_markup_takes_linear_time():
    for page in ("<" * 2_000_000, "<html " * 300_000, "<html lang=" + " " * 2_000_000, "<!--" * 500_000, "<script" * 200_000):
        began = time.perf_counter()
        visible(page), declared(page)
        assert time.perf_counter() - began < 5
