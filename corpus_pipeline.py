"""Training-text pipeline: documents -> clean, distinct, repeat-free texts -> packed token sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replaylens.llm import ngram_join, packing, suffix_dedup, toxicity
from replaylens.session import tune, written

#: Bytes of texts that Spark hands to a Python worker at a time. What workers make of a batch is several times its size.
TEXT_BATCH = 2 << 20


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable:
    """The stage with the session's settings and batches of TEXT_BATCH bytes, so that an executor's memory doesn't grow with its rows."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH))
        return stage(spark, docs, sf_dir)
    return run_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples don't call them toxic. Labels are learnt from these documents."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(docs.select(
        F.struct(*docs.columns).alias("row"), "text"), index)
    return scored.where("predicted = 0").select("row.*")


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of 100-byte strings that start earlier; a character goes if any of its bytes does.

    n_chars is that of the new text. A document of which nothing is left goes; an empty or null text that was empty
    before stays as it is.
    """
    found = suffix_dedup.remove_repeats(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    whole = found.where("n_removed = 0 or n_removed < n_bytes")
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(suffix_dedup.whole_characters(F.col("kept")))
    return whole.select("row.*", text.alias("__new")).select(*[
        F.col("__new").alias(c) if c == "text" else
        F.when(F.col("n_chars").isNotNull(), F.length("__new")).cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 1024."""
    tokens = packing.ByteTokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, tokens)


STAGES = [(name, in_small_batches(stage)) for name, stage in (
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_alike),
    ("suffix_dedup", remove_repeated_passages),
    ("packing", pack_sequences),
)]

ORACLE_SQL = None  # nearest examples and a linear program are beyond SQL; tests compare it with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's table written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
