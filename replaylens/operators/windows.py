"""Sliding windows of consecutive frames, and statistics over their last frames.

A window of T frames ending at i exists when the T-th kept frame up to i is
i - T + 1. Blocks carry a halo of T rows, so a session is windowed in many tasks
and no window is lost at a block edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import RARE_KEYS, WINDOW_FRAMES
from .ordered import BLOCK_ROWS, add_block, attach, carry, own_rows, with_halo, within


def _check(length: int) -> None:
    if length < 1:
        raise ValueError(f"a window needs at least one frame, got {length}")


def mark_windows(kept: DataFrame, length: int = WINDOW_FRAMES, gather: list[str] = (),
                 rows: int = BLOCK_ROWS) -> DataFrame:
    """Flag each kept frame: does a run open here, does a window end here, is it the
    run's first? ``gather`` adds ``w_<col>``: the column over the window, in time order.
    """
    _check(length)
    w = within(["session"], "frame_idx")
    i = F.col("frame_idx")
    out = (with_halo(kept, "frame_idx", rows, before=length)
           .withColumn("opens_run", ~F.lag("frame_idx", 1).over(w).eqNullSafe(i - 1))
           .withColumn("is_window", F.lag("frame_idx", length - 1).over(w).eqNullSafe(i - length + 1))
           .withColumn("first_window", F.col("is_window")
                       & ~F.lag("frame_idx", length).over(w).eqNullSafe(i - length)))
    for c in gather:
        out = out.withColumn(f"w_{c}", F.collect_list(c).over(w.rowsBetween(1 - length, 0)))
    return own_rows(out)


def sliding_windows(kept: DataFrame, length: int = WINDOW_FRAMES, gather: list[str] = (),
                    rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per window: its first and last index and the columns of its last frame."""
    return (mark_windows(kept, length, gather, rows).where("is_window")
            .withColumn("first_idx", F.col("frame_idx") - (length - 1))
            .withColumnRenamed("frame_idx", "last_idx")
            .drop("opens_run", "is_window", "first_window"))


def window_stats(kept: DataFrame, length: int = WINDOW_FRAMES, rows: int = BLOCK_ROWS) -> DataFrame:
    """Per session: runs, runs shorter than a window, windows."""
    agg = mark_windows(kept.select("session", "frame_idx"), length, rows=rows).groupBy("session").agg(
        F.count_if("opens_run").alias("runs"), F.count_if("first_window").alias("_long"),
        F.count_if("is_window").alias("windows"))
    return agg.select("session", "runs", (F.col("runs") - F.col("_long")).alias("runs_too_short"), "windows")


def runs(kept: DataFrame, rows: int = BLOCK_ROWS, block_rows: int | None = None) -> DataFrame:
    """Maximal runs of consecutive kept frames: start, end and length."""
    marked = mark_windows(kept.select("session", "frame_idx"), 1, rows=rows)
    blocked = (add_block(marked, ["session"], "frame_idx", block_rows, sized_by=kept)
               .withColumn("_start", F.when(F.col("opens_run"), F.col("frame_idx"))))
    before = carry(blocked, ["session"], {"_carry": (F.max("_start"), "last")})
    opened = F.last("_start", ignorenulls=True).over(within(["session"], "frame_idx"))
    return (attach(blocked, ["session"], before)
            .withColumn("run_start", F.coalesce(opened, F.col("_carry")))
            .groupBy("session", "run_start").agg(
                F.max("frame_idx").alias("run_end"), F.count(F.lit(1)).alias("run_length")))


def key_balance(windows: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """Held fraction of each key at the windows' last frames; NaN without windows."""
    rate = [F.coalesce(F.avg(F.col(f"k_{k}").cast("double")), F.lit(float("nan"))).alias(f"held_{k}") for k in keys]
    return windows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), *rate)


def look_balance(windows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean, population deviation and mean size of dx and dy at the last frames."""
    aggs = []
    for axis in ("dx", "dy"):
        x = F.col(axis).cast("double")
        aggs += [F.avg(x).alias(f"{axis}_mean"), F.stddev_pop(x).alias(f"{axis}_std"),
                 F.avg(F.abs(x)).alias(f"{axis}_mean_abs")]
    return windows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), *aggs)


def turn_threshold(windows: DataFrame) -> Column:
    """Population deviation of dx over these windows; 0 for a single one."""
    return windows.agg(F.when(F.count(F.lit(1)) > 1, F.stddev_pop(F.col("dx").cast("double")))
                       .otherwise(F.lit(0.0)).alias("thr")).scalar()


def flag_eventful(windows: DataFrame, keys: list[str], rare_keys: list[str] = RARE_KEYS,
                  threshold: float | None = None) -> DataFrame:
    """Flag windows that end on a rare key or a turn larger than the threshold."""
    rare = [k for k in keys if k in rare_keys]
    hit = F.lit(False)
    for k in rare:
        hit = hit | (F.col(f"k_{k}") > 0)
    cut = F.lit(float(threshold)) if threshold is not None else turn_threshold(windows)
    return (windows.withColumn("dx_threshold", cut)
            .withColumn("rare_hit", hit)
            .withColumn("dx_hit", F.abs("dx") > F.col("dx_threshold"))
            .withColumn("eventful", F.col("rare_hit") | F.col("dx_hit")))


def eventful_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if("eventful").alias("eventful"),
                       F.count_if("rare_hit").alias("rare_hit"), F.count_if("dx_hit").alias("dx_hit"))


def oversample(flagged: DataFrame, times: int) -> DataFrame:
    """Repeat eventful windows; for training rows only, never for evaluation."""
    return flagged.withColumn("copy", F.explode(F.sequence(
        F.lit(1), F.when(F.col("eventful"), F.lit(max(1, times))).otherwise(1))))
