"""Joins by time: newest state per frame, and mouse motion between frames.

Both sides are shuffled once, by session and time block, so a long session is
many tasks. Pass narrow frames: images do not belong in this shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import CONTACT_GRACE_S
from .ordered import add_block, attach, carry, time_block, within

def asof_state(frames: DataFrame, states: DataFrame, seconds: float | None = None) -> DataFrame:
    """Give each frame the newest state received at or before it, and its age.

    ``frames`` holds (session, t, ...); ``states`` (session, t, n, state), where n
    orders states of equal time. A state at the frame's own time counts. Frames
    before the first state get nulls.
    """
    rest = [c for c in frames.columns if c not in ("session", "t")]
    state_type = states.schema["state"].dataType
    left = frames.select("session", "t", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_n"),
                         F.struct(*rest).alias("_frame"), F.lit(None).cast(state_type).alias("_state"))
    right = states.select("session", "t", F.lit(0).alias("_kind"), F.col("n").cast("long").alias("_n"),
                          F.lit(None).cast(left.schema["_frame"].dataType).alias("_frame"),
                          F.col("state").alias("_state"))
    both = add_block(left.unionByName(right), ["session"], time_block("t", seconds))
    seen = F.when(F.col("_kind") == 0, F.struct("t", "_state"))
    before = carry(both, ["session"], {"_carry": (
        F.max_by(seen, F.when(F.col("_kind") == 0, F.struct("t", "_n"))), "last")})
    newest = F.last(seen, ignorenulls=True).over(
        within(["session"], "t", "_kind", "_n").rowsBetween(Window.unboundedPreceding, 0))
    return (attach(both, ["session"], before)
            .withColumn("_s", F.coalesce(newest, F.col("_carry")))
            .where("_kind = 1")
            .select("session", "t", "_frame.*", F.col("_s._state").alias("state"),
                    F.col("_s.t").alias("state_t"), (F.col("t") - F.col("_s.t")).alias("state_age")))


def accumulate_mouse(frames: DataFrame, mouse: DataFrame, seconds: float | None = None) -> DataFrame:
    """Sum mouse increments over (previous frame, this frame].

    Increments after a session's last frame belong to no frame and drop out.
    """
    left = frames.select("session", "t", F.lit(1).alias("_kind"), "frame_idx",
                         F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    right = mouse.select("session", "t", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("frame_idx"),
                         F.col("dx").cast("int"), F.col("dy").cast("int"))
    both = add_block(left.unionByName(right), ["session"], time_block("t", seconds))
    after = carry(both, ["session"], {"_next": (F.min_by("frame_idx", F.when(
        F.col("_kind") == 1, F.struct("t", "frame_idx"))), "first")}, later=True)
    # In falling order the next frame is the last one seen; see carry().
    closing = F.last("frame_idx", ignorenulls=True).over(
        within(["session"], F.desc("t"), F.desc("_kind"), F.desc("frame_idx")).rowsBetween(Window.unboundedPreceding, 0))
    return (attach(both, ["session"], after)
            .withColumn("frame_idx", F.coalesce(closing, F.col("_next")))
            .where("frame_idx IS NOT NULL")
            .groupBy("session", "frame_idx").agg(
                F.sum("dx").alias("dx"), F.sum("dy").alias("dy"),
                F.count_if(F.col("_kind") == 0).alias("n_events")))


def contact_report(frames: DataFrame, states: DataFrame, grace: float = CONTACT_GRACE_S) -> DataFrame:
    """Per session: first frame, first state, and whether a state came within the grace."""
    marks = (frames.select("session", F.col("t").alias("_f"), F.lit(None).cast("double").alias("_s"))
             .unionByName(states.select("session", F.lit(None).cast("double").alias("_f"), F.col("t").alias("_s"))))
    return (marks.groupBy("session").agg(F.min("_f").alias("first_frame_t"), F.min("_s").alias("first_state_t"))
            .where("first_frame_t IS NOT NULL")
            .withColumn("contacted", F.coalesce(
                F.col("first_state_t") <= F.col("first_frame_t") + grace, F.lit(False))))


def after_contact(frames: DataFrame, states: DataFrame, grace: float = CONTACT_GRACE_S,
                  require: bool = True) -> DataFrame:
    """Frames from the first state on, of sessions that made contact in time.

    With ``require=False`` sessions without timely contact keep all their frames;
    those before the first state simply have no state.
    """
    report = contact_report(frames, states, grace).select("session", "first_state_t", "contacted")
    joined = frames.join(report, "session")
    live = F.col("contacted") & (F.col("t") >= F.col("first_state_t"))
    return joined.where(live if require else live | ~F.col("contacted")).drop("first_state_t", "contacted")
