"""One query for each operator, over whole tables, with SQL that gives the same rows.

Arrays leave as text, joined by commas, beside their sizes. Positions leave as ``pos``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dataset import Dataset, concat_datasets, from_df, from_sequence, interleave_datasets
from ..functions import hex_bytes, split_words
from ..order import POS
from ..sources import shards
from ..tokenizers import BytesTokenizer

Query = Callable[[SparkSession, str], DataFrame]
BOS, EOS, PAD = -1, -2, -3

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _of(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> Dataset:
    columns = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "events": ["event_id", "user_id", "event_type", "value"], "conversations": ["conv_id", "turn", "text"], "orders": ["o_orderkey", "o_totalprice"]}[name]
    return from_df(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns), *keys)


def _joined(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


def _out(d: Dataset, *columns: str | Column) -> DataFrame:
    return d.to_df().select(F.col(POS).alias("pos"), *columns)


def _sized(d: Dataset, *columns: str) -> DataFrame:
    return _out(d, *(_joined(c) for c in columns), F.size(columns[0]).cast("bigint").alias("n"))


def _words(d: Dataset) -> Dataset:
    """Token ids: the lengths of the words."""
    return d.map({"input_ids": F.transform(split_words(F.col("text")), lambda w: F.length(w).cast("bigint"))})


_DOCS = "d as (select row_number() over (order by doc_id) - 1 as pos, * from documents)"
_EVENTS = "e as (select row_number() over (order by event_id) - 1 as pos, * from events)"
_IDS = r"list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: length(w)::bigint)"
_TOKENS = f"{_DOCS}, t as (select pos, {_IDS} as ids from d)"
_TALK = f"c as (select row_number() over (order by conv_id, turn) - 1 as pos, {_IDS} as ids from conversations)"


@query(f"with {_DOCS} select pos, doc_id, n_chars from d")
def seq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_of(spark, sf_dir, "documents", "doc_id"), "doc_id", "n_chars")


@query(f"with {_DOCS} select pos + k * (select count(*) from d) as pos, doc_id from d, range(3) r(k)")
def seq_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return _out(from_df(docs, "doc_id", repeat=True).take(3 * docs.count()), "doc_id")


@query()
def seq_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(from_df(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), "event_id", shuffle=True), "event_id")


@query()
def shuffle_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_of(spark, sf_dir, "events", "event_id").shuffle(1000), "event_id")


def _mux(spark: SparkSession, sf_dir: str, n_active: int | None) -> DataFrame:
    """Documents as if each source were a shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    names = [r["source"] for r in docs.select("source").distinct().orderBy("source").collect()]  # a name a shard
    numbers = spark.createDataFrame(list(zip(names, range(len(names)))), "source string, shard int")
    rows = docs.join(F.broadcast(numbers), "source").withColumn("row", F.row_number().over(Window.partitionBy("shard").orderBy("doc_id")).cast("bigint") - 1)  # a few numbers a shard
    counted = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    plan = shards.segments([counted[k] for k in range(len(names))], shards.epoch_orders(len(names), 1, False, 0), n_active or len(names))
    return shards.merged_rows(rows, plan).select(F.col(POS).alias("pos"), "doc_id", "source")


@query("with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as row from documents) select row_number() over (order by row, source) - 1 as pos, doc_id, source from r")
def files_mux_all_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mux(spark, sf_dir, None)


@query()
def files_mux_2_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mux(spark, sf_dir, 2)


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def jsonl_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload decoder of the shard source."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("props").alias("payload"))
    return shards.typed(events, shards.rows_schema("k bigint"))


@query(f"with {_DOCS} select pos, doc_id, upper(lang) as lang from d")
def map_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_of(spark, sf_dir, "documents", "doc_id").map({"lang": F.upper("lang")}), "doc_id", "lang")


@query("select row_number() over (order by doc_id) - 1 as pos, doc_id from documents where n_chars >= 500")
def filter_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_of(spark, sf_dir, "documents", "doc_id").filter("n_chars >= 500"), "doc_id")


def _halves(row: dict) -> dict | None:
    return {"doc_id": row["doc_id"], "half": row["n_chars"] // 2} if row["n_chars"] % 2 == 0 else None


_HALVES = "select row_number() over (order by doc_id) - 1 as pos, doc_id, n_chars // 2 as half from documents where n_chars % 2 = 0"


def _narrow(spark: SparkSession, sf_dir: str) -> Dataset:
    return from_df(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")


@query(_HALVES)
def filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_narrow(spark, sf_dir).filter_map(_halves, "doc_id bigint, half bigint"), "doc_id", "half")


@query(_HALVES)
def parallel_filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_narrow(spark, sf_dir).parallel_filter_map(_halves, "doc_id bigint, half bigint"), "doc_id", "half")


@query("select row_number() over (order by doc_id) - 1 as pos, doc_id, n_chars * 2 as twice from documents")
def parallel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_narrow(spark, sf_dir).parallel_map(lambda r: {"doc_id": r["doc_id"], "twice": r["n_chars"] * 2}, "doc_id bigint, twice bigint"), "doc_id", "twice")


@query("select row_number() over (order by doc_id) - 1 as pos, doc_id from documents where n_chars % 3 = 0")
def parallel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_narrow(spark, sf_dir).parallel_filter(lambda r: r["n_chars"] % 3 == 0), "doc_id")


@query(f"with {_EVENTS} select pos, event_id, pos as step from e")
def enumerate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_of(spark, sf_dir, "events", "event_id").enumerate(), "event_id", "step")


@query(f"with {_EVENTS} select pos, event_id from e where pos < 500")
def take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_of(spark, sf_dir, "events", "event_id").take(500), "event_id")


@query(f"with {_EVENTS} select pos // 5 as pos, event_id from e where pos % 5 = 2")
def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_of(spark, sf_dir, "events", "event_id").stride(5, 2), "event_id")


_ORDERS = "with o as (select row_number() over (order by o_orderkey) - 1 as pos, o_orderkey from orders), b as (select pos // 64 as pos, array_to_string(list(o_orderkey order by pos), ',') as o_orderkey, count(*) as n from o group by 1) select * from b"


@query(_ORDERS)
def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(from_df(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey").batch(64), "o_orderkey")


@query(_ORDERS + " where n = 64")
def batch_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(from_df(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey").batch(64, drop_last=True), "o_orderkey")


def _mean(rows: list[dict]) -> dict:
    return {"first": rows[0]["o_orderkey"], "rows": len(rows)}


@query("with o as (select row_number() over (order by o_orderkey) - 1 as pos, o_orderkey from orders) select pos // 64 as pos, min(o_orderkey) as first, count(*) as rows from o group by 1")
def batch_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_df(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey")
    return _out(rows.batch(64, _mean, schema="first bigint, rows bigint"), "first", "rows")


@query(f"with {_TOKENS} select pos, array_to_string(ids, ',') as input_ids, len(ids)::bigint as n from t")
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(_words(_of(spark, sf_dir, "documents", "doc_id")), "input_ids")


@query("select row_number() over (order by conv_id, turn) - 1 as pos, strlen(text)::bigint as n, md5(text) as same from conversations")
def tokenize_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as tokens, by expressions; the digest is of the text that they spell."""
    d = _of(spark, sf_dir, "conversations", "conv_id", "turn").map({"input_ids": hex_bytes(F.col("text"))})
    spelt = F.unhex(F.array_join(F.transform("input_ids", lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    return _out(d, F.size("input_ids").cast("bigint").alias("n"), F.md5(spelt).alias("same"))


@query("select row_number() over (order by conv_id, turn) - 1 as pos, strlen(text)::bigint as n from conversations")
def tokenize_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _of(spark, sf_dir, "conversations", "conv_id", "turn").tokenize(BytesTokenizer(), schema="conv_id bigint, turn bigint, text string, input_ids array<bigint>")
    return _out(d, F.size("input_ids").cast("bigint").alias("n"))


def _talk(spark: SparkSession, sf_dir: str) -> Dataset:
    return _words(_of(spark, sf_dir, "conversations", "conv_id", "turn"))


@query(f"with {_TALK} select pos, array_to_string(list_concat([{BOS}], ids, [{EOS}]), ',') as input_ids, len(ids)::bigint + 2 as n from c")
def add_bos_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(_talk(spark, sf_dir).add_bos_eos(BOS, EOS), "input_ids")


@query(f"with {_TALK} select pos, array_to_string(list_concat(ids, [257]), ',') as input_ids, len(ids)::bigint + 1 as n from c")
def ensure_bos_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer that adds the first token itself."""
    return _sized(_talk(spark, sf_dir).ensure_bos_eos(BytesTokenizer(begins=True)), "input_ids")


@query(f"with {_TALK}, k as (select pos, ids, unnest(range((len(ids) + 31) // 32)) as k from c) select row_number() over (order by pos, k) - 1 as pos, array_to_string(list_resize(ids[k * 32 + 1 : k * 32 + 32], 32, {PAD}), ',') as input_ids, 32::bigint as n from k")
def pad_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole messages, in pieces of 32 of which the last is filled up."""
    return _sized(_talk(spark, sf_dir).chunk(32, drop_remainder=False).pad({"input_ids": PAD}, 32), "input_ids")


def _chunk_sql(last: str) -> str:
    return f"with {_TOKENS}, k as (select pos, ids, unnest(range({last})) as k from t) select row_number() over (order by pos, k) - 1 as pos, array_to_string(ids[k * 50 + 1 : k * 50 + 50], ',') as input_ids, len(ids[k * 50 + 1 : k * 50 + 50])::bigint as n from k"


@query(_chunk_sql("len(ids) // 50"))
def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(_words(_of(spark, sf_dir, "documents", "doc_id")).chunk(50), "input_ids")


@query(_chunk_sql("(len(ids) + 49) // 50"))
def chunk_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(_words(_of(spark, sf_dir, "documents", "doc_id")).chunk(50, drop_remainder=False), "input_ids")


@query(f"with {_TOKENS}, x as (select pos, unnest(ids) as id, generate_subscripts(ids, 1) as k from t), y as (select id, row_number() over (order by pos, k) - 1 as i from x) select i // 64 as pos, array_to_string(list(id order by i), ',') as input_ids, count(*) as n from y group by 1 having count(*) = 64")
def concat_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(_words(_of(spark, sf_dir, "documents", "doc_id")).concat_chunk(64), "input_ids")


def _pack_sql(discard: bool) -> str:
    """The rows one after the other: a row that doesn't fit closes the pack, be it empty."""
    kept = " where len(ids) <= 2048" if discard else ""
    return f"""with recursive {_TOKENS}, l as (select row_number() over (order by pos) as i, pos, ids, len(ids) as n from t{kept}),
p(i, pack, used) as (
  select 0::bigint, 0::bigint, 0::bigint
  union all
  select l.i, case when p.used + l.n > 2048 then p.pack + 1 else p.pack end, case when p.used + l.n > 2048 then l.n else p.used + l.n end from p join l on l.i = p.i + 1
),
g as (select p.pack, list(l.ids order by l.i) as all_ids from p join l on l.i = p.i group by 1),
e as (select unnest(range((select max(pack) + 1 from p))) as pack),
f as (select e.pack, coalesce(flatten(g.all_ids)[:2048], []) as ids from e left join g on e.pack = g.pack)
select pack as pos, array_to_string(ids, ',') as input_ids, len(ids)::bigint as n from f where len(ids) > 0 or pack < (select max(pack) from p)"""


@query(_pack_sql(False))
def pack_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(_words(_of(spark, sf_dir, "documents", "doc_id")).pack_chunk(2048, ("input_ids",)), "input_ids")


@query(_pack_sql(True))
def pack_chunk_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(_words(_of(spark, sf_dir, "documents", "doc_id")).pack_chunk(2048, ("input_ids",), discard_long_samples=True), "input_ids")


def _language(spark: SparkSession, sf_dir: str, lang: str) -> Dataset:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return from_df(docs.where(F.col("lang") == lang), "doc_id")


def _interleave_sql(order: list[int], langs: list[str]) -> str:
    """Turn by turn: which source, and how many rows of it came before in the period."""
    turns = ", ".join(f"({i}, '{langs[s]}', {order[:i].count(s)}, {order.count(s)})" for i, s in enumerate(order))
    return f"""with s as (select lang, row_number() over (partition by lang order by doc_id) - 1 as r, doc_id from documents),
turns(i, lang, before, each) as (values {turns}),
placed as (select s.r // t.each * {len(order)} + t.i as pos, s.doc_id, s.lang from s join turns t on s.lang = t.lang and s.r % t.each = t.before),
ends as (select min(e) as e from (select (select count(*) from s where s.lang = t.lang) // t.each * {len(order)} + t.i as e from turns t where t.before = (select count(*) from s where s.lang = t.lang) % t.each))
select pos::bigint as pos, doc_id, lang from placed where pos < (select e from ends)"""


@query(_interleave_sql([0, 1], ["en", "fr"]))
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(interleave_datasets([_language(spark, sf_dir, x) for x in ("en", "fr")]), "doc_id", "lang")


@query(_interleave_sql([1, 0, 1, 1, 0, 1, 1, 0, 1, 1, 0, 1, 1, 0, 1, 1], ["en", "fr"]))
def interleave_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(interleave_datasets([_language(spark, sf_dir, x) for x in ("en", "fr")], [1, 2], chunk_size=16), "doc_id", "lang")


_CONCAT = "with x as (select 0 as s, c_custkey as k, c_name as name from customer union all select 1, s_suppkey, s_name from supplier) select row_number() over (order by s, k) - 1 as pos, name from x"


def _names(spark: SparkSession, sf_dir: str, table: str, key: str, name: str) -> Dataset:
    return from_df(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("k"), F.col(name).alias("name")), "k")


@query(_CONCAT)
def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(concat_datasets([_names(spark, sf_dir, "customer", "c_custkey", "c_name"), _names(spark, sf_dir, "supplier", "s_suppkey", "s_name")]), "name")


@query(_CONCAT)
def plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_names(spark, sf_dir, "customer", "c_custkey", "c_name") + _names(spark, sf_dir, "supplier", "s_suppkey", "s_name"), "name")


@query(f"with {_EVENTS} select pos, event_id from e")
def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_of(spark, sf_dir, "events", "event_id").cache(), "event_id")


@query(f"with {_EVENTS} select pos, event_id from e where pos >= 123")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader that took 123 rows goes on with."""
    d = _of(spark, sf_dir, "events", "event_id")
    return _out(d, "event_id").where(F.col("pos") >= d.state(123)["offset"])


@query("select i as pos, i * i as square from range(100) r(i)")
def from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(from_sequence([{"square": i * i} for i in range(100)]), "square")


@query(f"with {_TOKENS}, x as (select pos, unnest(list_concat([{BOS}], ids, [{EOS}])) as id, generate_subscripts(list_concat([{BOS}], ids, [{EOS}]), 1) as k from t), y as (select id, row_number() over (order by pos, k) - 1 as i from x), c as (select i // 128 as chunk, array_to_string(list(id order by i), ',') as ids, count(*) as n from y group by 1 having count(*) = 128) select chunk // 8 as pos, array_to_string(list(ids order by chunk), ';') as input_ids, count(*) as n from c group by 1")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to boundary tokens, to chunks of 128, in batches of 8."""
    d = _words(_of(spark, sf_dir, "documents", "doc_id")).add_bos_eos(BOS, EOS).concat_chunk(128).batch(8)
    rows = F.transform("input_ids", lambda x: F.array_join(x.cast("array<string>"), ","))
    return _out(d, F.array_join(rows, ";").alias("input_ids"), F.size("input_ids").cast("bigint").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
