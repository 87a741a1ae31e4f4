"""Scores of key and look predictions.

A prediction row is a window: (session, last_idx, side, probs ARRAY, truth ARRAY,
look_pred ARRAY, look_true ARRAY); look predictions may be standardized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (BROKEN_LIFT, COLLAPSE_RATIO, MIN_PROBE_FRAMES, MIN_PROBE_SESSIONS,
                            MIN_TRAIN_SESSIONS, MIN_TRAIN_WINDOWS, PRESS_THRESHOLD, SIGNAL_LIFT)
from ..functions.numeric import unstandardize

AXES = ["dx", "dy"]


def _per_key(pred: DataFrame, keys: list[str], by: list[str], stats: dict) -> DataFrame:
    """Aggregate every key in one pass; rows are expanded per key only afterwards.

    ``stats`` maps a name to a function of (probability, truth) giving an aggregate.
    """
    cells = []
    for i, k in enumerate(keys):
        p, y = F.get("probs", F.lit(i)), F.get("truth", F.lit(i)).cast("double")
        cells.append(F.struct(F.lit(k).alias("key"), *[f(p, y).alias(name) for name, f in stats.items()]))
    agg = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("_k"))
    return agg.select(*by, "n", F.inline("_k"))


def key_lift(pred: DataFrame, keys: list[str], baseline_from: str = "train") -> DataFrame:
    """Accuracy at p >= 0.5, majority baseline and lift per side and key.

    The baseline uses TRAIN rates, or with ``baseline_from="same"`` the rates of the
    side being scored.
    """
    scores = _per_key(pred, keys, ["side"], {
        "acc": lambda p, y: F.avg(((p >= 0.5).cast("double") == y).cast("double")),
        "held": lambda p, y: F.avg(y)})
    if baseline_from == "train":
        rates = scores.where("side = 'train'").select("key", F.col("held").alias("_rate"))
        scores = scores.join(F.broadcast(rates), "key", "left")  # one row per key
    elif baseline_from == "same":
        scores = scores.withColumn("_rate", F.col("held"))
    else:
        raise ValueError(f"unknown baseline {baseline_from!r}: use 'train' or 'same'")
    return (scores.withColumn("baseline", F.greatest("_rate", 1 - F.col("_rate")))
            .withColumn("lift", F.col("acc") - F.col("baseline")).drop("_rate"))


def mean_lift(lifts: DataFrame) -> DataFrame:
    """Mean lift of each side and the train-to-holdout gap, in one row."""
    def on(side):
        return F.avg(F.when(F.col("side") == side, F.col("lift")))
    return (lifts.agg(on("train").alias("train_lift"), on("holdout").alias("holdout_lift"))
            .withColumn("gap", F.col("train_lift") - F.col("holdout_lift")))


def _look(pred: DataFrame, stats: DataFrame | None) -> DataFrame:
    """Look columns per axis in raw units; without stats they stay standardized."""
    out = pred
    if stats is not None:
        row = stats.agg(F.struct(*[F.first(f"{a}_{s}").alias(f"{a}_{s}") for a in AXES for s in ("mean", "std")])
                        .alias("s")).scalar()
        out = out.withColumn("_st", row)
    for i, a in enumerate(AXES):
        p = F.get("look_pred", F.lit(i)).cast("double")
        if stats is not None:
            p = unstandardize(p, F.col(f"_st.{a}_mean"), F.col(f"_st.{a}_std"))
        out = out.withColumn(f"{a}_pred", p).withColumn(f"{a}_true", F.get("look_true", F.lit(i)).cast("double"))
    return out.drop("_st")


def _per_axis(df: DataFrame, by: list[str], stats: dict) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("axis"), *[
        f(F.col(f"{a}_true"), F.col(f"{a}_pred")).alias(n) for n, f in stats.items()]) for a in AXES]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("_a")).select(
        *by, "n", F.inline("_a"))


def look_error(pred: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Mean absolute look error in raw units against predicting no motion."""
    return (_per_axis(_look(pred, stats), ["side"], {
                "mae": lambda t, p: F.avg(F.abs(p - t)), "baseline": lambda t, p: F.avg(F.abs(t))})
            .withColumn("improve", F.col("baseline") - F.col("mae")))


def confusion(pred: DataFrame, keys: list[str], threshold: float = PRESS_THRESHOLD) -> DataFrame:
    """Press behaviour per key at a play threshold."""
    def pressed(p):
        return (p >= threshold).cast("double")
    out = _per_key(pred, keys, [], {
        "true_rate": lambda p, y: F.avg(y), "pred_rate": lambda p, y: F.avg(pressed(p)),
        "precision": lambda p, y: F.sum(pressed(p) * y) / F.greatest(F.sum(pressed(p)), F.lit(1e-9)),
        "recall": lambda p, y: F.sum(pressed(p) * y) / F.greatest(F.sum(y), F.lit(1e-9)),
        "mean_prob": lambda p, y: F.avg(p)})
    return out


def pearson(a: Column, b: Column) -> Column:
    """Correlation; NaN when either side is constant."""
    spread_a, spread_b = F.stddev_pop(a), F.stddev_pop(b)
    flat = (spread_a < 1e-9) | (spread_b < 1e-9)
    return F.when(flat, F.lit(float("nan"))).otherwise(
        F.try_divide(F.covar_pop(a, b), spread_a * spread_b))


def look_collapse(pred: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Does a look axis predict a near-constant value?"""
    return (_per_axis(_look(pred, stats), [], {
                "truth_std": lambda t, p: F.stddev_pop(t), "pred_std": lambda t, p: F.stddev_pop(p),
                "corr": pearson, "pred_mean": lambda t, p: F.avg(p), "truth_mean": lambda t, p: F.avg(t)})
            .withColumn("collapsed", F.col("pred_std") / F.greatest("truth_std", F.lit(1e-9)) < COLLAPSE_RATIO))


def hardest_turns(pred: DataFrame, stats: DataFrame | None = None, k: int = 8) -> DataFrame:
    """The k windows with the largest true turn, with what was predicted."""
    return (_look(pred, stats).orderBy(F.desc(F.abs("dx_true")), "session", "last_idx").limit(k)
            .select("session", "last_idx", "dx_true", "dx_pred", "dy_true", "dy_pred"))


def probe_verdict(lifts: DataFrame, n_frames: Column, n_sessions: Column,
                  converged: Column | None = None, side: str = "holdout") -> DataFrame:
    """Verdict on a probe from its mean lift and the data behind it."""
    lift = F.col("mean_lift")
    few = (n_frames < MIN_PROBE_FRAMES) | (n_sessions < MIN_PROBE_SESSIONS)
    band = F.when(lift > SIGNAL_LIFT, "SIGNAL").otherwise("FLAT")
    bad = ~converged if converged is not None else F.lit(False)
    return (lifts.where(F.col("side") == side).agg(F.avg("lift").alias("mean_lift"))
            .withColumn("provisional", few)
            .withColumn("verdict", F.when(bad, "NO RESULT: not converged")
                        .when(lift.isNull(), "NO RESULT: no holdout")
                        .when(lift < BROKEN_LIFT, "NO RESULT: distribution mismatch")
                        .otherwise(F.concat(band, F.when(F.col("provisional"), " (provisional)").otherwise("")))))


def baseline_verdict(volume: DataFrame) -> DataFrame:
    """Can a movement model's numbers be committed? ``volume`` has one row per side."""
    def of(side, c):
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    agg = volume.agg(of("train", "n_windows").alias("train_windows"),
                     of("holdout", "n_windows").alias("holdout_windows"),
                     F.coalesce(F.sum("n_sessions"), F.lit(0)).alias("n_sessions"))
    few = ((F.col("train_windows") < MIN_TRAIN_WINDOWS) | (F.col("n_sessions") < MIN_TRAIN_SESSIONS)
           | (F.col("holdout_windows") == 0))
    return agg.withColumn("verdict", F.when(F.col("holdout_windows") == 0, "NO GENERALISATION MEASURED")
                          .when(few, "PROVISIONAL").otherwise("COMMITTED"))
