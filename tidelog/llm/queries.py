"""The queries of this subpackage, for the registry at the top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.token_store import read_crc, write_store

    manifest = write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), end_id=1)
    return read_crc(manifest)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.bpe import ids_text, roundtrip_documents

    path = vocabulary("byte_bpe_50k.json")
    return roundtrip_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text().cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.lines import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.html import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.shards import balanced_shards

    placed = balanced_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.decontaminate import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=8)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]).cast("long")).alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_items") >= 2).alias("contaminated"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.warc import page_of, read_archive, write_archive

    found = read_archive(spark, write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


OP2_SQL = r"""
with d as (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as a from documents),
l as (select doc_id, r, unnest(a) as line, generate_subscripts(a, 1) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
g as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct r) >= 5),
m as (select k.*, g.key is not null and (k.doc_id is null or k.doc_id < g.keeper) as lost from k left join g on k.key = g.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (lost) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
from m group by r, doc_id
"""

OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""


def queries() -> dict:
    return {
        "op1_token_store": op1_token_store,
        "op2_line_dedup": op2_line_dedup,
        "op3_bpe": op3_bpe,
        "op4_html": op4_html,
        "op5_top_k": op5_top_k,
        "op6_sharding": op6_sharding,
        "op7_decontamination": op7_decontamination,
        "op8_toxicity": op8_toxicity,
        "op9_simhash": op9_simhash,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op5_top_k": OP5_SQL}
