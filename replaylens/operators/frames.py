"""Frame filters, their accounts, and selection of frames by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FREEZETIME, PHASE_NONE
from .ordered import even_positions, hashed_rank, number_rows, running_total


def is_alive() -> Column:
    """Alive, or recorded before the flag existed."""
    return F.col("alive").isNull() | (F.col("alive") > 0)


def not_freezetime() -> Column:
    """Everything but freezetime; unknown phases stay."""
    return F.coalesce("round_phase", F.lit(PHASE_NONE)) != FREEZETIME


def is_kept() -> Column:
    """Kept by the mask, or not masked."""
    return F.coalesce("keep", F.lit(True))


def gameplay(frames: DataFrame, gameplay_filter: bool = False, keep_mask: bool = False) -> DataFrame:
    """Serve gameplay frames. Both filters are off unless asked for.

    Apply after indexing and after any neighbour comparison: dropped frames must
    still count as gaps there.
    """
    if gameplay_filter:
        frames = frames.where(is_alive() & not_freezetime())
    return frames.where(is_kept()) if keep_mask else frames


def with_mask(frames: DataFrame, mask: DataFrame) -> DataFrame:
    """Attach ``keep`` (null where no current mask covers the frame) and the tint flag."""
    return (frames.join(mask.select("session", "frame_idx", "keep"), ["session", "frame_idx"], "left")
            .withColumn("dropped", ~is_kept()))


def exclusions(frames: DataFrame) -> DataFrame:
    """What each filter leaves out, per session.

    Freezetime counts only frames still alive; mask drops may overlap with both.
    """
    dead = F.col("alive") == 0
    return frames.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(dead).alias("n_masked_alive"),
        F.count_if(is_alive() & ~not_freezetime()).alias("n_masked_freeze"),
        F.count_if(~is_kept()).alias("n_masked_keep"),
        F.count_if(is_alive() & not_freezetime() & is_kept()).alias("n_served"))


def above_threshold(frames: DataFrame, threshold: float | Column) -> DataFrame:
    """Frames whose minimap variance exceeds the one pooled cut."""
    return frames.where(F.col("variance") > threshold)


def session_bases(lengths: DataFrame) -> DataFrame:
    """Global index of each session's first frame, in name order; from (session, n_frames)."""
    return running_total(lengths, "session", "n_frames", "global_base")


def with_global_index(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """Dense frame index over all sessions; the bases are one row per session."""
    return (frames.join(session_bases(lengths).select("session", "global_base"), "session")
            .withColumn("global_idx", F.col("global_base") + F.col("frame_idx")).drop("global_base"))


def batches(rows: DataFrame, idx: str, batch_size: int, seed: int | None = None,
            drop_last: bool = False) -> DataFrame:
    """Batch number and place of each row, in a seeded order.

    The order is that of a hash of (session, index, seed), so any engine and any
    retry gives the same batches.
    """
    digest = F.md5(F.concat_ws(":", "session", F.col(idx).cast("string"), F.lit(str(seed))))
    ranked = hashed_rank(rows, digest, ["session", idx])
    out = (ranked.withColumn("batch_id", F.floor(F.col("rank") / batch_size))
           .withColumn("place", (F.col("rank") % batch_size).cast("int")).drop("rank"))
    if drop_last:
        whole = rows.agg(F.floor(F.count(F.lit(1)) / batch_size).alias("n")).scalar()
        out = out.where(F.col("batch_id") < whole)
    return out


def fetch(request: DataFrame, frames: DataFrame, strict: bool = True) -> DataFrame:
    """Frames for a list of (pos, session, frame_idx), in request order.

    Every request is answered: a missing frame fails the job, or with ``strict`` off
    gives a row of nulls whose ``found`` is false.
    """
    out = request.join(frames.withColumn("found", F.lit(True)), ["session", "frame_idx"], "left")
    if not strict:
        return out.withColumn("found", F.coalesce("found", F.lit(False))).orderBy("pos")
    missing = F.raise_error(F.format_string("requested frame %s of session %s does not exist", "frame_idx", "session"))
    return out.where(F.coalesce("found", missing.cast("boolean"))).drop("found").orderBy("pos")


def first_rows(frames: DataFrame, k: int) -> DataFrame:
    return frames.orderBy("session", "frame_idx").limit(k)


def even_sample(frames: DataFrame, k: int, idx: str = "frame_idx") -> DataFrame:
    """Up to ``k`` evenly spaced frames of each session, by a dense index.

    Frames that carry their session's ``n_frames`` are picked one by one, so rows with
    images never shuffle. Without it the picks are joined: pass narrow rows then.
    """
    if "n_frames" in frames.columns:
        return frames.where(F.array_contains(even_positions(F.col("n_frames"), k), F.col(idx)))
    picks = (frames.groupBy("session").agg((F.max(idx) + 1).alias("_n"))
             .select("session", F.explode(even_positions(F.col("_n"), k)).alias(idx)))
    return frames.join(picks, ["session", idx], "left_semi")


def even_sample_where(frames: DataFrame, condition: Column, k: int, rows: int | None = None) -> DataFrame:
    """Evenly spaced sample of the frames that meet a condition, such as dropped ones."""
    chosen = number_rows(frames.where(condition), ["session"], ["frame_idx"], "frame_idx", "_nth", rows)
    return even_sample(chosen, k, "_nth").drop("_nth")


def stride_sample(rows: DataFrame, k: int, idx: str = "last_idx", block_rows: int | None = None) -> DataFrame:
    """Up to ``k`` rows at a fixed stride over all sessions, in (session, index) order."""
    counts = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n_frames"))
    numbered = number_rows(rows, ["session"], [idx], idx, "_nth", block_rows)
    placed = (numbered.join(session_bases(counts).select("session", "global_base"), "session")
              .withColumn("position", F.col("global_base") + F.col("_nth")).drop("global_base", "_nth"))
    picks = (rows.agg(F.count(F.lit(1)).alias("_n"))
             .select(F.explode(even_positions(F.col("_n"), k)).alias("position")))
    # k picks at most, so this side may be broadcast at any scale.
    return placed.join(F.broadcast(picks), "position", "left_semi")
