"""Gaps between frames: rate, jitter, stalls and chunk boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import LONG_GAP_FACTOR, LOOP_FPS, STALL_FACTOR
from .ordered import BLOCK_ROWS, own_rows, with_halo, within


def frame_rate(rows: DataFrame, fps: float | None = None) -> Column:
    """The given rate, or the one each session was recorded at (``file_fps``), or the usual one."""
    if fps is not None:
        return F.lit(fps)
    return F.coalesce("file_fps", F.lit(LOOP_FPS)) if "file_fps" in rows.columns else F.lit(LOOP_FPS)


def gaps(frames: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Every frame but a session's last, with the gap after it in seconds.

    Needs (session, frame_idx, t, chunk_idx), dense indices; keeps ``alive`` flips and
    the session's ``file_fps`` if the columns are there. Filter frames after this, not before.
    """
    w = within(["session"], "frame_idx")
    cols = ["session", "frame_idx", "t", "chunk_idx"] + [c for c in ("alive", "file_fps") if c in frames.columns]
    out = (with_halo(frames.select(*cols), "frame_idx", rows, after=1)
           .withColumn("gap", F.lead("t").over(w) - F.col("t"))
           .withColumn("at_boundary", F.lead("chunk_idx").over(w) != F.col("chunk_idx")))
    if "alive" in cols:
        out = out.withColumn("flips", F.lead("alive").over(w) != F.col("alive"))
    return own_rows(out).where("gap IS NOT NULL")


def timing_aggs(fps: Column) -> list[Column]:
    return [
        (F.count(F.lit(1)) + 1).alias("n_frames"),
        F.when(F.avg("gap") > 0, 1.0 / F.avg("gap")).otherwise(F.lit(float("nan"))).alias("fps"),
        (F.avg("gap") * 1000).alias("mean_ms"), (F.max("gap") * 1000).alias("max_ms"),
        (F.min("gap") * 1000).alias("min_ms"), (F.stddev_pop("gap") * 1000).alias("jitter_ms"),
        F.count_if(F.col("gap") > LONG_GAP_FACTOR / fps).alias("long_gaps")]


def timing_summary(gap_rows: DataFrame, fps: float | None = None) -> DataFrame:
    """Per session: real rate, mean, extreme and jitter of gaps (ms), long gaps.

    Long is measured against ``fps``, or against each session's own rate if it is not given.
    """
    return gap_rows.groupBy("session").agg(*timing_aggs(frame_rate(gap_rows, fps)))


def largest_gaps(gap_rows: DataFrame, k: int = 5) -> DataFrame:
    """The k largest gaps of each session; only k rows per task are shuffled."""
    order = Window.partitionBy("session").orderBy(F.desc("gap"), "frame_idx")
    return (gap_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("session", "rank", "frame_idx", (F.col("gap") * 1000).alias("gap_ms"), "at_boundary"))


def boundary_gaps(gap_rows: DataFrame) -> DataFrame:
    """The gap after the last frame of each chunk but the final one."""
    return gap_rows.where("at_boundary").select(
        "session", "chunk_idx", (F.col("frame_idx") + 1).alias("boundary"), (F.col("gap") * 1000).alias("gap_ms"))


def stall_aggs(fps: Column) -> list[Column]:
    stall = F.col("gap") * 1000 > STALL_FACTOR * 1000.0 / fps
    return [F.count_if("at_boundary").alias("boundaries"), F.count_if(stall).alias("stalls"),
            F.count_if(stall & F.col("at_boundary")).alias("boundary_stalls")]


def stall_diagnosis(gap_rows: DataFrame, fps: float | None = None) -> DataFrame:
    """Do the stalls sit at chunk boundaries? A stall is a gap above 3 frame budgets of its session."""
    return diagnosed(gap_rows.groupBy("session").agg(*stall_aggs(frame_rate(gap_rows, fps))))


def diagnosed(agg: DataFrame) -> DataFrame:
    """Add the share and the verdict to counts of stalls and boundaries."""
    return (agg.withColumn("boundary_share", F.col("boundary_stalls") / F.greatest("stalls", F.lit(1)))
            .withColumn("diagnosis", F.when(F.col("boundaries") == 0, "single chunk")
                        .when(F.col("boundary_stalls") > 0, "boundary stalls").otherwise("stalls elsewhere")))


def alive_flips(gap_rows: DataFrame) -> DataFrame:
    """Changes of the alive flag between neighbouring frames."""
    return gap_rows.groupBy("session").agg(F.count_if("flips").alias("alive_flips"))
