"""One pooled cut between blank and present minimaps, from image variance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import MODE_GAP_DECADES, OTSU_BINS, REPORT_BINS
from ..functions.numeric import histogram_bin, log_variance
from .ordered import order_statistics


def _logs(variance: DataFrame) -> DataFrame:
    return variance.select(log_variance(F.col("variance")).alias("lv")).where("lv IS NOT NULL")


def histogram(variance: DataFrame, bins: int = OTSU_BINS) -> DataFrame:
    """Pooled histogram of log10(variance + 1): every bin, its edges and its count."""
    logs = _logs(variance)
    span = logs.agg(F.struct(F.min("lv").alias("lo"), F.max("lv").alias("hi")).alias("s")).scalar()
    counts = (logs.withColumn("_s", span)
              .withColumn("bin", F.when(F.col("_s.hi") > F.col("_s.lo"), histogram_bin(
                  F.col("lv"), F.col("_s.lo"), F.col("_s.hi"), bins)).otherwise(0))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    step = (F.col("_s.hi") - F.col("_s.lo")) / bins
    return (variance.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
            .join(F.broadcast(counts), "bin", "left").withColumn("_s", span)
            .select("bin", (F.col("_s.lo") + F.col("bin") * step).alias("lo"),
                    (F.col("_s.lo") + (F.col("bin") + 1) * step).alias("hi"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def report_histogram(variance: DataFrame) -> DataFrame:
    return histogram(variance, REPORT_BINS)


def otsu_cut(hist: DataFrame) -> DataFrame:
    """One row (cut_bin, threshold): the cut that best separates two classes.

    Runs over the histogram's few rows; the first best cut wins. A spread below
    1e-6 decades has no cut and gives threshold 0.
    """
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = (hist.where("n > 0").withColumn("centre", (F.col("lo") + F.col("hi")) / 2)
         .withColumn("w", F.col("n") / F.sum("n").over(whole))
         .withColumn("wx", F.col("w") * F.col("centre"))
         .withColumn("w0", F.sum("w").over(order)).withColumn("m0", F.sum("wx").over(order))
         .withColumn("m", F.sum("wx").over(whole)))
    w0, w1 = F.col("w0"), 1.0 - F.col("w0")
    gap = F.col("m0") / w0 - (F.col("m") - F.col("m0")) / w1
    score = F.when((w0 > 1e-12) & (w1 > 1e-12), w0 * w1 * gap * gap).otherwise(F.lit(0.0))
    best = h.withColumn("score", score).agg(
        F.max(F.struct("score", (-F.col("bin")).alias("_neg"), "centre")).alias("b"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    usable = F.col("hi") - F.col("lo") >= 1e-6
    return best.select(
        F.when(usable, -F.col("b._neg")).alias("cut_bin"),
        F.when(usable, F.col("b.centre")).alias("threshold_log"),
        F.when(usable, F.pow(F.lit(10.0), F.col("b.centre")) - 1.0).otherwise(F.lit(0.0)).alias("threshold"),
        F.when(usable, "otsu split").when(F.col("b").isNull(), "no data").otherwise("single value").alias("reason"))


def pooled_cut(variance: DataFrame, bins: int = OTSU_BINS) -> DataFrame:
    """The cut with its separation quality: one row for all sessions together."""
    cut = otsu_cut(histogram(variance, bins))
    sides = (_logs(variance).withColumn("_thr", cut.select("threshold_log").scalar())
             .agg(F.count(F.lit(1)).alias("n_frames"),
                  F.count_if(F.col("lv") <= F.col("_thr")).alias("n_low"),
                  F.avg(F.when(F.col("lv") <= F.col("_thr"), F.col("lv"))).alias("low_mean"),
                  F.avg(F.when(F.col("lv") > F.col("_thr"), F.col("lv"))).alias("high_mean")))
    row = cut.agg(F.struct(F.first("cut_bin").alias("cut_bin"), F.first("threshold").alias("threshold"),
                           F.first("reason").alias("reason")).alias("c")).scalar()
    gap = F.coalesce(F.col("high_mean") - F.col("low_mean"), F.lit(0.0))
    return sides.withColumn("_c", row).select(
        "_c.*", "n_frames", "n_low", F.coalesce(F.try_divide("n_low", "n_frames"), F.lit(0.0)).alias("frac_below"),
        gap.alias("gap_decades"), (gap >= MODE_GAP_DECADES).alias("bimodal"))


def clean_report(mask: DataFrame) -> DataFrame:
    """Kept and dropped frames per session, from mask rows."""
    return mask.groupBy("session").agg(
        F.count(F.lit(1)).alias("total_frames"), F.count_if("keep").alias("kept"),
        F.count_if(~F.col("keep")).alias("dropped"), F.max("threshold").alias("threshold"),
    ).withColumn("dropped_frac", F.col("dropped") / F.col("total_frames"))


def clean_total(report: DataFrame) -> DataFrame:
    agg = report.agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("total_frames").alias("total_frames"),
                     F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"))
    return agg.withColumn("dropped_frac", F.col("dropped") / F.greatest("total_frames", F.lit(1)))


def variance_summary(variance: DataFrame) -> DataFrame:
    """Smallest, exact median and largest variance, without sorting all values."""
    n = F.col("n")
    return (order_statistics(variance, [], "variance", {
                "lowest": F.lit(0), "_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2), "highest": n - 1})
            .select("n", "lowest", ((F.col("_a") + F.col("_b")) / 2).alias("median"), "highest"))
