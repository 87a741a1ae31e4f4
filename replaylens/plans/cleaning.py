"""The hygiene pass: variance of every minimap, one pooled cut, masks beside the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import MASK_VERSION, RADAR_HW
from ..functions.pixels import radar_variance
from ..operators.threshold import clean_report, pooled_cut, report_histogram, variance_summary
from ..session import written
from ..sources.masks import build_mask, write_mask


class NotBimodal(ValueError):
    """Blank and present frames do not separate; a cut would drop the wrong ones."""


def clean(spark: SparkSession, frames: DataFrame, mask_path: str, force: bool = False,
          hw=RADAR_HW, report_path: str | None = None) -> DataFrame:
    """Write a keep-mask for every session and return the report.

    Images are read once; variance is 8 bytes per frame from then on. Without a
    clearly bimodal distribution nothing is written unless forced. The report goes to
    ``report_path`` as JSON lines, if given, with the lengths of a session's chunks if
    ``frames`` has them.
    """
    with_chunks = ["chunk_idx"] if "chunk_idx" in frames.columns else []
    variance = written(radar_variance(frames, ["session", "frame_idx", *with_chunks], "radar", hw), "variance")
    cut = written(pooled_cut(variance), "cut")
    row = cut.first()
    if row["reason"] == "no data":
        raise ValueError("no frames to mask")
    if not row["bimodal"] and not force:
        raise NotBimodal(f"cut {row['threshold']:.2f} splits classes only {row['gap_decades']:.2f} decades apart")
    mask = build_mask(variance, cut)
    write_mask(mask, mask_path)
    if report_path is not None:
        write_report(stored_report(mask, variance if with_chunks else None), report_path)
    return clean_report(mask)


def stored_report(mask: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """One row per session as it is stored; ``frames`` (session, chunk_idx) give the chunk lengths."""
    report = clean_report(mask).select(
        "session", F.lit(MASK_VERSION).alias("mask_schema"), "total_frames", "kept", "dropped", "dropped_frac",
        F.col("threshold").alias("threshold_variance"))
    if frames is None:
        return report.withColumn("chunk_lengths", F.lit(None).cast("array<long>"))
    lengths = frames.groupBy("session", "chunk_idx").agg(F.count(F.lit(1)).alias("n")).groupBy("session").agg(
        F.array_sort(F.collect_list(F.struct("chunk_idx", "n"))).alias("_c"))
    return report.join(lengths.select("session", F.col("_c.n").alias("chunk_lengths")), "session", "left")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def preview(variance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a clean would do, writing no mask: one row of figures, and a histogram of the variance.

    ``variance`` holds (session, frame_idx, variance), as ``clean`` computes it.
    """
    cut = pooled_cut(variance).select("threshold", "reason", "bimodal")
    row = cut.agg(F.struct(*[F.first(c).alias(c) for c in cut.columns]).alias("c")).scalar()
    blank = variance.withColumn("_c", row).agg(
        F.count_if(F.col("variance") <= F.col("_c.threshold")).alias("n_blank"),
        F.count_if(F.col("variance") > F.col("_c.threshold")).alias("n_kept"),
        F.countDistinct("session").alias("n_sessions"), F.first("_c").alias("_c"))
    figures = variance_summary(variance).crossJoin(F.broadcast(blank)).select(  # one row each
        "n", "n_sessions", "lowest", "median", "highest", "_c.*", "n_blank", "n_kept")
    return figures, report_histogram(variance)
