"""What happened in a session: keys, clicks, mouse, life, weapons.

All of these are plain aggregates, reduced before the shuffle, so a long session
needs no special care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_activity(frames: DataFrame) -> DataFrame:
    """Frames each key was held, and their share of the frames that log the key.

    Every key in ``key_names`` counts, however many a session logs. Needs ``keys`` and
    ``key_names``; the expanded rows are summed before they are shuffled.
    """
    pressed = F.explode(F.arrays_zip(F.col("key_names").alias("key"), F.col("keys").alias("held")))
    n, held = F.count(F.lit(1)), F.sum(F.coalesce(F.col("_x.held").cast("long"), F.lit(0)))
    return (frames.select("session", pressed.alias("_x")).where("_x.key IS NOT NULL")
            .groupBy("session", F.col("_x.key").alias("key"))
            .agg(held.alias("frames_held"), (100.0 * held / n).alias("pct_held")))


def click_aggs() -> list[Column]:
    n = F.count(F.lit(1))
    return [F.sum("lclick").alias("left_held"), (100.0 * F.sum("lclick") / n).alias("left_pct"),
            F.sum("rclick").alias("right_held"), (100.0 * F.sum("rclick") / n).alias("right_pct")]


def mouse_aggs() -> list[Column]:
    n = F.count(F.lit(1))
    return [F.min("dx").alias("dx_min"), F.max("dx").alias("dx_max"), F.avg(F.abs("dx")).alias("dx_mean_abs"),
            F.min("dy").alias("dy_min"), F.max("dy").alias("dy_max"), F.avg(F.abs("dy")).alias("dy_mean_abs"),
            F.count_if(F.col("dx") != 0).alias("dx_moving"),
            (100.0 * F.count_if(F.col("dx") != 0) / n).alias("dx_moving_pct"),
            ((F.min("dx") == 0) & (F.max("dx") == 0)).alias("mouse_dead")]


def alive_aggs() -> list[Column]:
    n, alive = F.count("alive"), F.count_if(F.col("alive") > 0)
    return [alive.alias("n_alive"), (n - alive).alias("n_not_alive"),
            (100.0 * alive / F.greatest(n, F.lit(1))).alias("alive_pct"),
            F.when(n == 0, F.lit(None).cast("string")).when(alive == 0, "no alive frames")
            .when(alive == n, "every frame alive").otherwise("mixed").alias("alive_note")]


def state_aggs() -> list[Column]:
    """Health over alive frames (all frames if the flag is absent); ammo where it exists."""
    scope = F.coalesce(F.col("alive"), F.lit(1)) > 0
    health = F.when(scope, F.col("health"))
    armed = F.col("ammo_clip") >= 0
    return [F.count(health).alias("health_n"), F.min(health).alias("health_min"),
            F.max(health).alias("health_max"), F.avg(health).alias("health_mean"),
            F.count_if(armed).alias("ammo_n"),
            F.min(F.when(armed, F.col("ammo_clip"))).alias("clip_min"),
            F.max(F.when(armed, F.col("ammo_clip"))).alias("clip_max"),
            F.min(F.when(armed, F.col("ammo_reserve"))).alias("reserve_min"),
            F.max(F.when(armed, F.col("ammo_reserve"))).alias("reserve_max"),
            (F.max(F.length("active_weapon")) == 0).alias("weapon_always_empty")]


def clicks(frames: DataFrame) -> DataFrame:
    return frames.groupBy("session").agg(*click_aggs())


def mouse_summary(frames: DataFrame) -> DataFrame:
    return frames.groupBy("session").agg(*mouse_aggs())


def alive_summary(frames: DataFrame) -> DataFrame:
    return frames.groupBy("session").agg(*alive_aggs())


def health_ammo(frames: DataFrame) -> DataFrame:
    return frames.groupBy("session").agg(*state_aggs())


def phase_counts(frames: DataFrame) -> DataFrame:
    return frames.where("round_phase IS NOT NULL").groupBy("session", "round_phase").agg(
        F.count(F.lit(1)).alias("n"))


def top_weapons(frames: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent weapons of each session; ties by name."""
    counts = frames.where("active_weapon IS NOT NULL").groupBy("session", "active_weapon").agg(
        F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("session").orderBy(F.desc("n"), "active_weapon")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
