"""One query for each operator, over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, language, mixing, quality, quotes, repeats, sharding, simhash
from .spread import bounded_batches

#: A public vocabulary of 50,256 byte-level ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.substring_repeats(_table(spark, sf_dir, "documents"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(_table(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    targets = {"quality 1, toxic 0": 0.9, "quality 0, toxic 0": 0.08, "quality 1, toxic 1": 0.02}
    return mixing.rates(docs, mixing.fit(docs, mixing.train(docs, _table(spark, sf_dir, "labels")), targets))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_languages(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    """Each document's tokens, and whether decoding them gives its text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", bpe.encoded_exact(F.col("text"), path).alias("e"))
    return docs.select("doc_id", "e.tokens", F.size("e.tokens").alias("n_tokens"), "e.exact")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.accepted_scores(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.close_documents(_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.suffix_repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    all_of = (op1_substring_dedup, op2_quotation_linking, op3_mixing, op4_language_id, op5_bpe, op6_sharding, op7_ngram_jaccard_join, op8_quality_rules, op9_simhash, op10_suffix_array_dedup)
    return {f.__name__: f for f in all_of}


_NEAR_CLASSES = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as w
  from documents where doc_id is not null and text is not null
), sets as (
  select row_number() over () as k, doc_id, s from (
    select distinct doc_id, list_sort(list_distinct(
      case when len(w) < 3 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as s
    from words where len(w) > 0)
), grams as (select k, len(s) as size, unnest(s) as gram from sets),
pairs as (
  select a.k as x, b.k as y from grams a join grams b on a.gram = b.gram and a.k < b.k
  group by a.k, b.k, a.size, b.size having count(*) >= 0.6 * (a.size + b.size - count(*)) - 1e-9
), edges as (select x, y from pairs union all select y, x from pairs),
reached(k, r) as (
  select distinct x, x from edges
  union
  select e.y, reached.r from reached join edges e on e.x = reached.k
), classes as (select reached.k, min(s.doc_id) as class_id from reached join sets s on s.k = reached.r group by reached.k)
select s.doc_id, c.class_id, cast(count(*) as bigint) as links
from edges e join sets s on s.k = e.x join classes c on c.k = e.x group by s.k, s.doc_id, c.class_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query, numpy's hashes, trained models and spans within texts left out."""
    return {"op7_ngram_jaccard_join": _NEAR_CLASSES}
