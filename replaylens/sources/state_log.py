"""State updates: JSON lines written by a state receiver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.state import extract_state, payload_of


def log_name(path="_metadata.file_path") -> F.Column:
    """Session of a log line: base name of its file without ``.jsonl``."""
    return F.regexp_extract(path, r"([^/]+?)(\.jsonl)?$", 1)


def parse_lines(lines: DataFrame, expected_token: str | None = None) -> DataFrame:
    """Parse text lines (``session``, ``value``) into typed state updates.

    Lines that are not JSON objects with a time keep their text in ``bad_line``. A field
    of an unexpected kind is null in an update that is otherwise used. A wrong token is
    only flagged: the update is still used.
    """
    # inline() keeps the optimizer from repeating the parse for every field read from it.
    parsed = lines.select("session", "value", F.inline_outer(F.array(F.struct(
        F.try_parse_json("value").alias("_v")))))
    flat = parsed.select("session", "value", F.inline_outer(F.array(F.struct(
        F.try_variant_get("_v", "$.t_perf", "double").alias("t"),
        F.try_variant_get("_v", "$.t_wall", "string").alias("t_wall"),
        F.try_variant_get("_v", "$.n", "bigint").alias("n"),
        payload_of(F.try_variant_get("_v", "$.payload", "variant")).alias("payload")))))
    flat = flat.select("session", "t", "t_wall", "n", "payload",
                       F.when(F.col("t").isNull(), F.col("value")).alias("bad_line"))
    token = F.col("payload.auth.token")
    mismatch = (F.lit(False) if expected_token is None
                else F.coalesce(token != expected_token, F.lit(False)))
    return (flat.withColumn("state", extract_state("payload"))
            .withColumn("token_mismatch", mismatch).drop("payload"))


def read_state_log(spark: SparkSession, path: str, expected_token: str | None = None) -> DataFrame:
    """All updates of the log files under ``path``; the file name is the session."""
    return parse_lines(spark.read.text(path).select(log_name().alias("session"), "value"), expected_token)


def read_state_stream(spark: SparkSession, path: str, expected_token: str | None = None) -> DataFrame:
    """The same as an unbounded stream over a drop folder."""
    return parse_lines(spark.readStream.text(path).select(log_name().alias("session"), "value"), expected_token)


def good_updates(updates: DataFrame) -> DataFrame:
    return updates.where("bad_line IS NULL").drop("bad_line")


def bad_lines(updates: DataFrame) -> DataFrame:
    return updates.where("bad_line IS NOT NULL").select("session", "bad_line")


def update_quality(updates: DataFrame) -> DataFrame:
    """Per session: updates received, lines dropped as bad, token mismatches."""
    return updates.groupBy("session").agg(
        F.count_if(F.col("bad_line").isNull()).alias("n_updates"),
        F.count_if(F.col("bad_line").isNotNull()).alias("n_bad"),
        F.count_if(F.col("token_mismatch") & F.col("bad_line").isNull()).alias("n_token_mismatch"))
