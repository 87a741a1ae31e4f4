"""Whole-session train / holdout splits. A session is never divided."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..fixed_values import HASH_BUCKETS, HOLDOUT_FRACTION, PROBE_HOLDOUT_FRACTION
from .ordered import running_total

TRAIN, HOLDOUT = "train", "holdout"


@F.pandas_udf(IntegerType())
def blake2_bucket(names: pd.Series) -> pd.Series:
    """Stable bucket of a session name: 8-byte BLAKE2b, big-endian, mod 1000."""
    return names.map(lambda n: int.from_bytes(
        hashlib.blake2b(n.encode("utf-8"), digest_size=8).digest(), "big") % HASH_BUCKETS)


def md5_bucket(name: Column) -> Column:
    """A bucket any SQL engine can compute; another hash, so another split."""
    return (F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long") % HASH_BUCKETS).cast("int")


def bucket(name: str | Column, hash_name: str = "blake2b") -> Column:
    column = F.col(name) if isinstance(name, str) else name
    if hash_name == "blake2b":
        return blake2_bucket(column)
    if hash_name == "md5":
        return md5_bucket(column)
    raise ValueError(f"unknown hash {hash_name!r}: use 'blake2b' or 'md5'")


def split_sessions(sessions: DataFrame, fraction: float = HOLDOUT_FRACTION,
                   manual: list[str] | None = None, hash_name: str = "blake2b") -> DataFrame:
    """Add bucket and side to a table with one row per usable session.

    A side depends on the name alone, so later sessions never move earlier ones.
    Sessions in ``manual`` are held out; all others keep their hashed side.
    """
    forced = F.col("session").isin(list(manual)) if manual else F.lit(False)
    return (sessions.withColumn("bucket", bucket("session", hash_name))
            .withColumn("side", F.when(forced | (F.col("bucket") < fraction * HASH_BUCKETS), HOLDOUT)
                        .otherwise(TRAIN)))


def balanced_split(sessions: DataFrame, fraction: float = PROBE_HOLDOUT_FRACTION) -> DataFrame:
    """Largest sessions to TRAIN until it holds ``1 - fraction`` of all frames.

    ``sessions`` holds (session, n_frames). Both sides get a session if there are
    two or more: the smallest of TRAIN, or the largest of HOLDOUT, changes side.
    """
    keyed = sessions.withColumn("_key", F.struct((-F.col("n_frames")).alias("a"), F.col("session").alias("b")))
    ends = keyed.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.sum("n_frames").alias("total"),
        F.min("_key").alias("largest"), F.max("_key").alias("smallest")).alias("e")).scalar()
    placed = (running_total(keyed, "_key", "n_frames", "before").withColumn("_e", ends)
              .withColumn("_goal", F.col("_e.total") * (1.0 - fraction)))
    several = F.col("_e.n") >= 2
    # The last session starts latest: if even that is below the goal, all are TRAIN.
    no_holdout = F.col("_e.total") + F.col("_e.smallest.a") < F.col("_goal")
    no_train = F.col("_goal") <= 0
    side = (F.when(several & no_holdout & (F.col("_key") == F.col("_e.smallest")), HOLDOUT)
            .when(several & no_train & (F.col("_key") == F.col("_e.largest")), TRAIN)
            .when(F.col("before") < F.col("_goal"), TRAIN).otherwise(HOLDOUT))
    return placed.withColumn("side", side).where("_e.total > 0").drop("_key", "_goal", "_e")


def on_side(df: DataFrame, split: DataFrame, side: str) -> DataFrame:
    """Rows of the sessions on one side."""
    return df.join(split.where(F.col("side") == side).select("session"), "session", "left_semi")


def with_side(df: DataFrame, split: DataFrame) -> DataFrame:
    return df.join(split.select("session", "side"), "session")


def split_report(split: DataFrame) -> DataFrame:
    """Sessions and buckets per side; both sides always have a row."""
    sides = split.sparkSession.createDataFrame([(TRAIN,), (HOLDOUT,)], "side STRING")
    agg = split.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("bucket").alias("min_bucket"),
                                    F.max("bucket").alias("max_bucket"))
    return (sides.join(agg, "side", "left")
            .select("side", F.coalesce("n", F.lit(0)).alias("n_sessions"), "min_bucket", "max_bucket",
                    F.when(F.col("n").isNull(), F.concat(F.col("side"), F.lit(" is empty"))).alias("note")))


def split_volume(frames: DataFrame, windows: DataFrame, split: DataFrame) -> DataFrame:
    """Sessions, frames and windows per side."""
    def per_session(df, name):
        return df.groupBy("session").agg(F.count(F.lit(1)).alias(name))
    return (split.select("session", "side")
            .join(per_session(frames, "f"), "session", "left")
            .join(per_session(windows, "w"), "session", "left")
            .groupBy("side").agg(F.count(F.lit(1)).alias("n_sessions"),
                                 F.coalesce(F.sum("f"), F.lit(0)).alias("n_frames"),
                                 F.coalesce(F.sum("w"), F.lit(0)).alias("n_windows")))
