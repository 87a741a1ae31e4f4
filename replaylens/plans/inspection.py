"""The session report: timing, activity, state and pixels, one row per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import pixel_range
from ..operators import activity, timing
from ..operators.frames import even_sample


def pixel_sample(frames: DataFrame, column: str, hw, k: int = 50) -> DataFrame:
    """Pixel range over up to k evenly spaced frames of each session.

    Give frames their ``n_frames`` (read from ``chunks_to_sample``), so that chunks
    without a picked frame stay closed and images are not shuffled.
    """
    kept = ["session", "frame_idx", column] + (["n_frames"] if "n_frames" in frames.columns else [])
    sampled = even_sample(frames.select(*kept), k)
    return (pixel_range(sampled, ["session"], column, hw).groupBy("session").agg(
                F.min("px_min").alias(f"{column}_min"), F.max("px_max").alias(f"{column}_max"),
                (F.sum("px_sum") / F.sum("px_n")).alias(f"{column}_mean"))
            .withColumn(f"{column}_flat", F.col(f"{column}_max") - F.col(f"{column}_min") < 5))


def inspect_frames(frames: DataFrame, fps: float | None = None) -> DataFrame:
    """Everything the scalar columns tell about each session, at its own frame rate unless one is given.

    One aggregate over frames, one over gaps; the results are one row per session.
    """
    counted = frames.groupBy("session").agg(
        F.count(F.lit(1)).alias("frames"), *activity.click_aggs(), *activity.mouse_aggs(),
        *activity.alive_aggs(), *activity.state_aggs())
    gap_rows = timing.gaps(frames)
    rate = timing.frame_rate(gap_rows, fps)
    flips = [F.count_if("flips").alias("alive_flips")] if "alive" in frames.columns else []
    timed = gap_rows.groupBy("session").agg(*timing.timing_aggs(rate), *timing.stall_aggs(rate), *flips)
    return counted.join(timing.diagnosed(timed).drop("n_frames"), "session", "left")


def inspection(sessions: DataFrame, alignment: DataFrame, sizes: DataFrame, frames: DataFrame,
               kind: DataFrame | None = None) -> DataFrame:
    """The full report, as one row and one JSON text per session."""
    report = (sessions.select("session", "path", "complete", "total_frames")
              .join(alignment.select("session", "aligned", "n_chunks", "misaligned"), "session", "left")
              .join(sizes.select("session", "size_mb"), "session", "left")
              .join(inspect_frames(frames), "session", "left"))
    if kind is not None:
        report = report.join(kind, "session", "left")
    return report.withColumn("report", F.to_json(F.struct(*[c for c in report.columns])))
