"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, clustering, embeddings, fingerprints, hard_negatives, licenses, line_dedup, ngram_join,
               packing, suffix_dedup, toxicity, url_filters)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark, sf_dir):
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    tokens = packing.ByteTokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), tokens)


def op6_url_filters(spark, sf_dir):
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in
                                 enumerate(("user", "assistant"))], conversations.schema)
    return chat.digests(conversations.unionByName(odd))


def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_clustering(spark, sf_dir):
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark, sf_dir):
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_dedup, op2_bpe, op3_ngram_join, op4_fingerprints, op5_packing, op6_url_filters, op7_toxicity,
    op8_suffix_dedup, op9_chat, op10_license_scan, op11_hard_negatives, op12_clustering, op13_line_dedup)}
_CONTROL = chat.CONTROL % ""
_SEGMENT_CHARS = " + ".join(f"length(regexp_replace({c}, '{_CONTROL}', '\\1\\\\\\2\\3', 'g'))" for c in ("role", "text"))
CHAT_SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), ''))
           as loss_sha256,
       sum(10 + {_SEGMENT_CHARS})::bigint as formatted_chars
from t group by 1"""
ORACLES = {"op9_chat": CHAT_SQL, "op6_url_filters": url_filters.oracle_sql(), "op10_license_scan": licenses.oracle_sql(),
           "op11_hard_negatives": hard_negatives.oracle_sql(), "op12_clustering": clustering.oracle_sql(),
           "op13_line_dedup": line_dedup.oracle_sql()}
