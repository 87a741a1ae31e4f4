"""Changes in state and input over time, and the verdicts drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import SYNC_DIRECTION_SHARE, SYNC_TOLERANCE_FRAMES
from .ordered import (BLOCK, add_block, attach, carry, order_statistics, time_block, with_previous,
                      within)

WATCHED = ["alive", "health", "round_phase", "map_phase", "active_weapon", "spectating"]


def _differs(field: str) -> Column:
    return ~F.col(f"state.{field}").eqNullSafe(F.col(f"prev.state.{field}"))


def _with_last_state(states: DataFrame, seconds: float | None) -> DataFrame:
    return with_previous(
        states, ["session"], ["t", "n"], time_block("t", seconds), ["t", "state"],
        seen={"had_local": F.col("state.has_local_state"), "had_spectating": F.col("state.spectating")})


def died() -> Column:
    """Alive before, and not known to be alive now."""
    return F.coalesce(F.col("prev.state.alive"), F.lit(False)) & ~F.coalesce("state.alive", F.lit(False))


def death_reason() -> Column:
    return F.when(F.col("state.spectating"), "spectating").otherwise("health 0")


def change_events(states: DataFrame, seconds: float | None = None) -> DataFrame:
    """Updates that changed something, with the names of what changed.

    ``states`` holds (session, t, n, state). A health change needs both values;
    the first local state and the first spectating update are announced once.
    """
    s = _with_last_state(states, seconds)
    both_health = F.col("state.health").isNotNull() & F.col("prev.state.health").isNotNull()
    names = F.array_compact(F.array(
        F.when(F.col("state.has_local_state") & ~F.col("had_local"), "local_state"),
        F.when(both_health & _differs("health"), "health"),
        F.when(died(), "death"),
        F.when(_differs("active_weapon"), "weapon"),
        F.when(F.col("state.spectating") & ~F.col("had_spectating"), "spectating"),
        F.when(_differs("round_phase"), "round_phase"),
        F.when(_differs("map_phase"), "map_phase")))
    return s.withColumn("changed", names).where(F.size("changed") > 0).select(
        "session", "t", "n", "changed", "state")


def watched_changes(states: DataFrame, seconds: float | None = None) -> DataFrame:
    """Updates in which any watched field differs from the update before."""
    s = _with_last_state(states, seconds)
    names = F.array_compact(F.array(*[F.when(_differs(f), f) for f in WATCHED]))
    return s.withColumn("changed", names).where(F.size("changed") > 0).select("session", "t", "n", "changed")


def death_events(states: DataFrame, seconds: float | None = None) -> DataFrame:
    return (_with_last_state(states, seconds).where(died())
            .select("session", "t", "n", death_reason().alias("reason")))


def cadence(states: DataFrame, seconds: float | None = None) -> DataFrame:
    """Updates per session: count, rate, mean gap and exact p50 / p95 gap (s)."""
    s = with_previous(states.select("session", "t", "n"), ["session"], ["t", "n"],
                      time_block("t", seconds), ["t"])
    s = s.withColumn("gap", F.col("t") - F.col("prev.t"))
    base = s.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_updates"), (F.max("t") - F.min("t")).alias("span_s"),
        F.avg("gap").alias("mean_gap"))
    n = F.col("n")
    ranks = order_statistics(s, ["session"], "gap", {
        "p50_gap": F.floor(n / 2), "p95_gap": F.least(n - 1, F.floor(n * 0.95))})
    return (base.join(ranks.drop("n"), "session", "left")
            .withColumn("per_second", F.when(F.col("span_s") > 0, F.col("n_updates") / F.col("span_s"))))


def feasibility(states: DataFrame, seconds: float | None = None) -> DataFrame:
    """Does a session's update stream carry our own health and life?"""
    s = _with_last_state(states, seconds)
    sid = F.col("state.steamid")
    agg = s.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_updates"),
        F.bool_or("state.has_local_state").alias("saw_local_state"),
        F.bool_or(F.col("state.health").isNotNull()).alias("saw_health"),
        F.count_if(died()).alias("deaths"), F.bool_or("state.spectating").alias("saw_spectating"),
        F.min_by(sid, F.when(sid != "", F.struct("t", "n"))).alias("own_id"))
    return agg.withColumn("verdict", feasibility_verdict())


def feasibility_verdict() -> Column:
    return (F.when(F.col("n_updates") == 0, "NO DATA")
            .when(F.col("saw_local_state") & F.col("saw_health"), "FEASIBLE").otherwise("PARTIAL"))


def coverage(sampled: DataFrame) -> DataFrame:
    """What a check of sampled frames actually exercised.

    ``sampled`` holds frames with stored ``alive`` and the raw ``state`` joined to
    them; a spectating frame that reads alive is a failure.
    """
    alive = F.col("alive") > 0
    spect = F.coalesce("state.spectating", F.lit(False))
    agg = sampled.groupBy("session").agg(
        F.bool_or(alive).alias("saw_alive"), F.bool_or(spect).alias("saw_spectating"),
        F.bool_or(spect & alive).alias("spectating_alive"),
        F.bool_or(~alive & ~spect & F.coalesce(F.col("state.health") == 0, F.lit(False))).alias("saw_own_death"))
    return agg.withColumn("verdict", F.when(F.col("spectating_alive"), "FAIL")
                          .when(F.col("saw_alive") & F.col("saw_spectating"), "PASS")
                          .when(F.col("saw_alive") & F.col("saw_own_death"), "PARTIAL: no spectating seen")
                          .when(F.col("saw_alive"), "PARTIAL: no death seen").otherwise("INCONCLUSIVE"))


def neighbours_in_state(frames: DataFrame, rows: int | None = None) -> DataFrame:
    """Next and previous kept / dropped frame of each frame; itself where there is none."""
    blocked = add_block(frames, ["session"], "frame_idx", rows)
    i = F.col("frame_idx")
    which = {"kept": F.when(F.col("keep"), i), "dropped": F.when(~F.col("keep"), i)}
    ahead = carry(blocked, ["session"], {f"_n_{k}": (F.min(c), "first") for k, c in which.items()}, later=True)
    behind = carry(blocked, ["session"], {f"_p_{k}": (F.max(c), "last") for k, c in which.items()})
    # Rising order for what lies behind, falling order for what lies ahead; see carry().
    rising = within(["session"], "frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    falling = within(["session"], F.desc("frame_idx")).rowsBetween(Window.unboundedPreceding, -1)
    out = attach(blocked, ["session"], ahead, behind)
    for k, c in which.items():
        out = (out.withColumn(f"next_{k}", F.coalesce(F.last(c, ignorenulls=True).over(falling), F.col(f"_n_{k}"), i))
               .withColumn(f"prev_{k}", F.coalesce(F.last(c, ignorenulls=True).over(rising), F.col(f"_p_{k}"), i)))
    return out.drop(BLOCK, *[f"_{d}_{k}" for d in "np" for k in which])


def switch_point(frames: DataFrame, rows: int | None = None) -> DataFrame:
    """Best frame k to split a session into a rightward and a leftward part.

    The score of k counts dx > 0 before k and dx < 0 from k on. It equals the sum
    of signs before k plus all leftward frames, so one prefix sum replaces trying
    every k. The first maximum wins.
    """
    blocked = add_block(frames.select("session", "frame_idx", F.signum("dx").cast("int").alias("_s")),
                        ["session"], "frame_idx", rows)
    before = carry(blocked, ["session"], {"_base": (F.sum("_s"), "sum")})
    inside = within(["session"], "frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    scored = (attach(blocked, ["session"], before)
              .withColumn("_score", F.coalesce("_base", F.lit(0)) + F.coalesce(F.sum("_s").over(inside), F.lit(0))))
    best = F.max(F.when(F.col("frame_idx") >= 1, F.struct("_score", (-F.col("frame_idx")).alias("_neg"))))
    agg = scored.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_s") < 0).alias("_left"), best.alias("_b"))
    return agg.select("session", "n", (-F.col("_b._neg")).alias("best_k"),
                      (F.col("_b._score") + F.col("_left")).alias("best_score"),
                      ((F.col("_b._score") + F.col("_left")) / F.col("n")).alias("separation"))


def sync_verdict(frames: DataFrame, splits: DataFrame, rows: int | None = None) -> DataFrame:
    """Judge a scripted sweep: right until ``split_at``, left from there.

    ``splits`` holds (session, split_at). Direction is judged on moving frames only.
    """
    j = frames.join(splits, "session")
    right, dx = F.col("frame_idx") < F.col("split_at"), F.col("dx")

    def share(good, moving):
        return F.when(F.count_if(moving) > 0, F.count_if(good) / F.count_if(moving)).otherwise(F.lit(0.0))
    agg = j.groupBy("session", "split_at").agg(
        F.avg(F.when(right, dx)).alias("right_mean"), F.avg(F.when(~right, dx)).alias("left_mean"),
        share(right & (dx > 0), right & (dx != 0)).alias("right_share"),
        share(~right & (dx < 0), ~right & (dx != 0)).alias("left_share"))
    def ok(c):
        return F.coalesce(c, F.lit(False))
    ok_right = ok((F.col("right_mean") > 0) & (F.col("right_share") >= SYNC_DIRECTION_SHARE))
    ok_left = ok((F.col("left_mean") < 0) & (F.col("left_share") >= SYNC_DIRECTION_SHARE))
    near = ok(F.abs(F.col("best_k") - F.col("split_at")) <= SYNC_TOLERANCE_FRAMES)
    return (agg.join(switch_point(frames, rows), "session")
            .withColumn("verdict", F.when(ok_right & ok_left & near, "PASS")
                        .when(ok_right & ok_left, "MOSTLY OK").otherwise("FAIL")))


def key_edges(frames: DataFrame, managed: list[str], rows: int | None = None) -> DataFrame:
    """Press and release events from ``held`` key sets; everything is released at the end.

    Only changes count and unmanaged keys are ignored.
    """
    mine = frames.withColumn("held", F.array_intersect(
        F.coalesce("held", F.array().cast("array<string>")), F.array(*[F.lit(k) for k in managed])))
    s = with_previous(mine.select("session", "frame_idx", "held"), ["session"], ["frame_idx"],
                      "frame_idx", ["held"], rows=rows)
    none = F.array().cast("array<string>")
    was = F.coalesce("prev.held", none)

    def events(keys, kind):
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("event"), k.alias("key")))
    changes = s.select("session", "frame_idx", F.explode(F.concat(
        events(F.array_except(was, "held"), "release"), events(F.array_except("held", was), "press"))).alias("_e"))
    last = mine.groupBy("session").agg(F.max_by(F.struct("frame_idx", "held"), "frame_idx").alias("_l"))
    final = last.select("session", F.col("_l.frame_idx").alias("frame_idx"),
                        F.explode(events(F.col("_l.held"), "release_all")).alias("_e"))
    return changes.unionByName(final).select("session", "frame_idx", "_e.event", "_e.key")
