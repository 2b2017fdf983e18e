"""Language of web pages by Bayesian fusion of evidence.

Of each page four things count: the likelihood of its visible text under byte
trigrams of each language, trained on labelled documents; the language that its
markup declares; the suffix of its address; and a prior of its host. How far a
declaration or a suffix can be trusted, and what a host's pages are written in, come
from grouped sums of the text's posteriors over all pages. A host's prior is
smoothed towards its domain's, and that towards that of all pages; a page's own
posterior is taken out of its host's and domain's sums.

    log P(lang | page) = temper * log P(text | lang) + log P(declared | lang)
                         + log P(suffix | lang) + log P(lang | host) + constant

Defined cases: null or empty markup has no text evidence, a null or odd address the
host "" and the suffix ""; what nothing is declared for counts as declaring "". A
page is always assigned a language, of equals the first by name; without any
labelled document the language is null. Null page_ids and repeated rows are pages as
any other. Whole texts are read, very long ones and those of odd markup in time that is
linear in their length. An empty table of pages has no rows. Extra columns are not read.
"""

from __future__ import annotations

import html as markup
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .spread import table

_BITS = 16
_HIDDEN = regex.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)", regex.S | regex.I)
# Each scan ends at the next mark, so that none is read more than once.
_TAG = regex.compile(r"<[^<>]*+>")
_DECLARED = regex.compile(r"<html\b[^<>]*?\blang\s*+=\s*+[\"']?\s*+([A-Za-z]+)", regex.I)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else 32 if b < 32 else b for b in range(256)], dtype=np.uint32)


def visible(page: str) -> str:
    """A page's text, without scripts, styles, comments and tags."""
    text = _TAG.sub(" ", _HIDDEN.sub(" ", page))
    return markup.unescape(text) if "&" in text else text


def declared(page: str) -> str:
    found = _DECLARED.search(page)
    return found[1].lower() if found else ""


def address(url: str | None) -> tuple[str, str, str]:
    """Host, domain and suffix."""
    try:
        host = (urlsplit(url or "").hostname or "").rstrip(".")
    except ValueError:
        host = ""
    parts = host.split(".")
    return host, ".".join(parts[-2:]), parts[-1] if len(parts) > 1 else ""


def trigrams(c: flat.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text within the chunk, and bucket, of all byte trigrams in lower case, runs of white space as one."""
    low = _LOWER[c.data]
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[c.cuts[:-1][c.cuts[:-1] < len(low)]] = True
    own = np.repeat(np.arange(len(c.rows)), np.diff(c.cuts))[keep]
    low = low[keep]
    if len(low) < 3:
        return own[:0], low[:0]
    code = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    one = own[2:] == own[:-2]
    return own[:-2][one], (code[one] * np.uint32(2654435761)) >> np.uint32(32 - _BITS)


def train(docs: DataFrame, max_docs: int = 4000, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each trigram bucket in them. max_docs bounds the labelled
    documents that are read, those whose doc_id hashes least."""
    chosen = docs.where("doc_id is not null and lang is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("bigint")).alias("h")).distinct().orderBy("h", "doc_id").limit(max_docs)
    texts = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("lang", "text")  # at most max_docs ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for c in flat.chunks(batch.column(1)):
                own, grams = trigrams(c)
                names, which = np.unique(langs[c.rows.start : c.rows.stop].astype(str), return_inverse=True)
                for k, name in enumerate(names.tolist()):
                    sums[name] = sums.get(name, 0) + np.bincount(grams[which[own] == k], minlength=1 << _BITS)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "gram": at.astype(np.int32), "n": counts[at]}, schema=pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())]))

    got = rows.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(got["lang"]))
    counts = np.full((1 << _BITS, len(langs)), smooth)
    for k, name in enumerate(langs):
        part = got[got["lang"] == name]
        counts[part["gram"].to_numpy(), k] += part["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0))


def likelihoods(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    out = [np.zeros((0, model.shape[1]))]
    for c in flat.chunks(texts):
        own, grams = trigrams(c)
        out.append(np.column_stack([np.bincount(own, weights=model[grams, k], minlength=len(c.rows)) for k in range(model.shape[1])]))
    return np.concatenate(out)


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray, temper: float) -> DataFrame:
    """page_id, host, domain, suffix, declared, and for each language ll_k and p_k, the text's posterior."""
    k = len(langs)
    names = [*(f"ll_{i}" for i in range(k)), *(f"p_{i}" for i in range(k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, raw = batch.column(1).to_pylist(), [x or "" for x in batch.column(2).to_pylist()]
            ll = temper * likelihoods(pa.array([visible(x) for x in raw], pa.large_string()), model)
            ll -= ll.max(axis=1, keepdims=True)
            p = np.exp(ll)
            p /= p.sum(axis=1, keepdims=True)
            parts = [address(u) for u in urls]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[i] for x in parts], pa.string()) for i in range(3)), pa.array([declared(x) for x in raw], pa.string()), *(pa.array(a[:, i]) for a in (ll, p) for i in range(k))],
                names=["page_id", "host", "domain", "suffix", "declared", *names],
            )

    columns = ", ".join(f"{x} double" for x in names)
    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, f"page_id bigint, host string, domain string, suffix string, declared string, {columns}")


def languages(pages: DataFrame, langs: list[str], model: np.ndarray, temper: float = 0.05, host_weight: float = 5.0, domain_weight: float = 10.0, smooth: float = 1.0) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) of each page."""
    if not langs:
        empty = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("bigint").alias("page_id"), empty.alias("lang"), F.lit(None).cast("double").alias("probability"), empty.alias("text_lang"), empty.alias("declared"), empty.alias("host"))
    k = range(len(langs))
    have = table(evidence(pages, langs, model, temper)).df
    total = have.agg(*(F.sum(f"p_{i}").alias(f"t_{i}") for i in k), F.countDistinct("suffix").alias("suffixes"), F.countDistinct("declared").alias("declarations"))
    sums = {key: have.groupBy(key).agg(*(F.sum(f"p_{i}").alias(f"{key}_{i}") for i in k)) for key in ("host", "domain", "suffix", "declared")}
    rows = have.crossJoin(F.broadcast(total))  # one row
    for key in ("domain", "suffix", "declared"):
        rows = rows.join(sums[key], key)
    # One row a host; the pages of a hot one are spread by AQE or the broadcast of the sums.
    rows = rows.join(sums["host"], "host")

    def less_own(key: str, i: int):
        return F.greatest(F.col(f"{key}_{i}") - F.col(f"p_{i}"), F.lit(0.0))

    def added(xs):
        out = F.lit(0.0)
        for x in xs:
            out = out + x
        return out

    whole = added(F.col(f"t_{i}") for i in k)
    root = [(F.col(f"t_{i}") + smooth) / (whole + smooth * len(langs)) for i in k]
    n_domain, n_host = added(less_own("domain", i) for i in k), added(less_own("host", i) for i in k)
    domain = [(less_own("domain", i) + domain_weight * root[i]) / (n_domain + domain_weight) for i in k]
    host = [(less_own("host", i) + host_weight * domain[i]) / (n_host + host_weight) for i in k]
    odds = [
        F.col(f"ll_{i}") + F.log(host[i])
        + F.log((less_own("suffix", i) + smooth) / (F.col(f"t_{i}") + smooth * F.col("suffixes")))
        + F.log((less_own("declared", i) + smooth) / (F.col(f"t_{i}") + smooth * F.col("declarations")))
        for i in k
    ]
    rows = rows.select("page_id", "declared", "host", F.array(*(F.col(f"p_{i}") for i in k)).alias("p"), F.array(*odds).alias("odds"))
    best = F.array_max("odds")
    names = F.array(*(F.lit(x) for x in langs))
    return rows.select(
        "page_id",
        F.element_at(names, F.array_position("odds", best).cast("int")).alias("lang"),
        (1 / F.aggregate("odds", F.lit(0.0), lambda s, x: s + F.exp(x - best))).alias("probability"),
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"),
        "declared",
        "host",
    )


def page_languages(spark: SparkSession, docs: DataFrame, pages: DataFrame, **options: float) -> DataFrame:
    langs, model = train(docs)
    return languages(pages, langs, model, **options)
