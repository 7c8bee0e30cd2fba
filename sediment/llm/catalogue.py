"""Queries over the test tables, one for each operator, and their SQL where SQL can say it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sediment.llm import imatch, lm, nbest, packing, quality, simhash, token_store, topk, toxicity, warc
from sediment.llm.common import crc_mod, new_path, table, text_bytes

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=2)
    return token_store.digests(token_store.read_store(spark, path))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2, TOKENIZER, inside=True)
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, usable=crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edits(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2, window=4096))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, the classifier's verdict, and a Gumbel top-k draw of a quarter of the rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weighed = quality.weigh(docs, quality.fit(docs, labels), ["doc_id", F.xxhash64(text_bytes()).alias("mark")])
    return quality.resample(weighed, docs.count() // 4, ["doc_id", "mark"]).drop("mark")


def op10_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.digests(nbest.encode(table(spark, sf_dir, "documents"), PIECES, n=3))


QUERIES = {"op1_token_store": op1_token_store, "op2_lm": op2_lm, "op3_top_k": op3_top_k, "op4_toxicity": op4_toxicity, "op5_imatch": op5_imatch, "op6_packing": op6_packing, "op7_warc": op7_warc,
           "op8_simhash": op8_simhash, "op9_quality": op9_quality, "op10_nbest": op10_nbest}

# SQL for the parts of a query that SQL can state; see the tests for the rest.
ORACLES: dict[str, str] = {
    "op3_top_k": """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024*x::double)::bigint) as v from embeddings
 where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
 q as (select vec_id as query_id, v as qv from v where vec_id%100=0),
 s as (select query_id, vec_id, list_sum(list_transform(range(1,len(v)+1), lambda i: v[i]*qv[i]))::bigint as score from q join v on vec_id<>query_id),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
 select query_id, rank::int as rank, vec_id, score from r where rank<=10""",
    "op7_warc": """with p as (select page_id, coalesce(html,'') as h from pages), d as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest, max(page_id) over (partition by h) as m from p)
 select page_id, payload_bytes, payload_digest, case when payload_bytes>=1000 and page_id<>m then 'revisit' else 'response' end as record_type,
 case when payload_bytes>=1000 and page_id<>m then m end as refers_to, cast(null as varchar) as error from d""",
}
