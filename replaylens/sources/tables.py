"""Parquet forms of sessions and look statistics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import CHUNK_FRAMES, LOOK_STD_FLOOR
from ..operators.ordered import index_block
from .generations import bucket_of, next_generation, read_newest, write_generation


def write_frames(frames: DataFrame, path: str, chunk_frames: int = CHUNK_FRAMES,
                 rows_per_file: int = 65_536) -> None:
    """Lay frames out by session and chunk, for pruned scans.

    Files hold whole index blocks of one session, so a long session is written by
    many tasks; the job commit takes the place of a per-chunk rename.
    """
    grain = max(1, rows_per_file // chunk_frames) * chunk_frames
    (frames.withColumn("chunk_idx", F.floor(F.col("frame_idx") / chunk_frames).cast("int"))
     .repartition("session", index_block("frame_idx", grain))
     .sortWithinPartitions("session", "frame_idx")
     .write.partitionBy("session").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def replace_sessions(frames: DataFrame, path: str, chunk_frames: int = CHUNK_FRAMES) -> None:
    """Store the sessions in ``frames`` as a generation of a table, in place of what it had of them.

    All of them change at once, when the generation is committed. Sessions share hashed
    buckets, so the table stays listable however many there are; ``write_frames`` gives each a folder of its own.
    """
    spark = frames.sparkSession
    placed = frames.withColumn("chunk_idx", F.floor(F.col("frame_idx") / chunk_frames).cast("int"))
    write_generation(placed, path, next_generation(spark, path), [F.col("session"), index_block("frame_idx")])


def read_sessions(spark: SparkSession, path: str, schema: str, session: str | None = None) -> DataFrame:
    """The newest stored frames of every session, or of one, whose bucket alone is then read."""
    rows = read_newest(spark, path, schema)
    if session is not None:
        rows = rows.where((F.col("bucket") == bucket_of(F.lit(session))) & (F.col("session") == session))
    return rows.drop("bucket")


def read_frames_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def finished_sessions(alignment: DataFrame) -> DataFrame:
    """Sessions table rows for sessions whose frames passed the alignment check."""
    return alignment.where("aligned").select(
        "session", F.col("n_frames").alias("total_frames"), F.lit(True).alias("complete"))


def write_look_stats(stats: DataFrame, path: str) -> None:
    """Store the one row of TRAIN mean and standard deviation of dx and dy."""
    stats.select(
        "dx_mean", "dy_mean",
        F.greatest("dx_std", F.lit(LOOK_STD_FLOOR)).alias("dx_std"),
        F.greatest("dy_std", F.lit(LOOK_STD_FLOOR)).alias("dy_std"),
    ).coalesce(1).write.mode("overwrite").parquet(path)


def read_look_stats(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored row, or None: predictions then stay standardized."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
