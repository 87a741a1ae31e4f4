"""End-to-end jobs: serve sets, minimap probe, movement baseline, policy replay."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..fixed_values import (HOLDOUT_FRACTION, MOVEMENT_KEYS, PRESS_THRESHOLD, PROBE_HOLDOUT_FRACTION,
                            PROBE_KEYS, WINDOW_FRAMES)
from ..functions.actions import action_vector, key_columns, mouse_step, pressed_keys
from ..functions.numeric import standardize, unstandardize
from ..functions.pixels import resolve_input
from ..operators import evaluate, probe
from ..operators.events import key_edges
from ..operators.frames import above_threshold, even_sample, gameplay, stride_sample
from ..operators.split import balanced_split, on_side, split_sessions, split_volume, with_side
from ..operators.threshold import pooled_cut
from ..operators.windows import flag_eventful, key_balance, look_balance, oversample, sliding_windows
from ..operators.validate import counted_frames, header_alignment, require_radar
from ..sources.chunks import chunks_to_sample, place_chunks, read_frames, read_headers, session_metadata
from ..session import written
from ..sources.manifests import listed_chunks, scan_sessions, usable_sessions
from ..sources.serving import mask_slices, serve_by_chunk, serve_in_order


@dataclass
class Dataset:
    """Tables of a recordings folder; no chunk file is read until an action."""
    sessions: DataFrame
    split: DataFrame
    headers: DataFrame
    metadata: DataFrame
    _stored: tuple | None = field(default=None, repr=False)

    def stored_headers(self) -> DataFrame:
        """The headers, read from the chunk files once and kept as a table, since serving looks at them several times."""
        if self._stored is None or self._stored[0] is not self.headers:
            self._stored = self.headers, written(self.headers, "headers")
        return self._stored[1]

    def checked_chunks(self, arrays: list[str] | None = None) -> DataFrame:
        """Placed chunks; reading one fails if its session can't be served whole.

        That is so if its arrays differ in length between chunks or an array is in some of
        them only, if the manifest counts other frames than the chunks hold, or if minimaps
        are asked for and there are none. Decided by joins of chunk headers, before images.
        """
        headers = self.stored_headers()
        state = header_alignment(headers).join(
            self.sessions.select("session", "total_frames"), "session").select(
            "session", "misaligned", "total_frames", F.col("n_frames").alias("_counted"), "len_radar")
        name = F.col("session")
        wrong = F.when(F.size("misaligned") > 0, F.concat(
            F.lit("arrays are not aligned in session "), name, F.lit(": "), F.array_join("misaligned", ", ")))
        wrong = wrong.when(F.col("total_frames") != F.col("_counted"), F.format_string(
            "session %s has %s frames where its manifest has %s", "session", "_counted", "total_frames"))
        if "radar" in (arrays or []):
            wrong = wrong.when(F.col("len_radar") == 0, F.concat(
                F.lit("input 'radar': no radar array in session "), name))
        checked = place_chunks(headers).join(state.select("session", wrong.alias("_wrong")), "session")
        path = F.when(F.col("_wrong").isNull(), F.col("chunk_path")).otherwise(F.raise_error(F.col("_wrong")))
        return checked.withColumn("chunk_path", path).drop("_wrong")

    def frames(self, arrays: list[str] | None = None, sample: int | None = None, mask: DataFrame | None = None,
               gameplay_filter: bool = False, crop=None) -> DataFrame:
        """Frames of all usable sessions with key names, side and session length.

        These are joined to the chunk list, so frames come out of the decoding task
        complete and are not shuffled here. Sessions that can't be served whole fail the
        job (see ``checked_chunks``). ``sample`` keeps that many evenly spaced
        frames per session and opens only the chunks that hold one.

        ``mask`` is a keep-mask table, and with ``gameplay_filter`` frames that are dead or
        in freezetime go too; both act inside the decoder, and frame indices stay those of
        the recording. Stale and absent masks, and recordings without state, filter nothing.
        ``crop`` cuts the array ``frames`` inside the decoder too.
        """
        placed = self.checked_chunks(arrays)
        if mask is not None:
            placed = mask_slices(mask, written(placed, "chunks"))
        if sample is not None:
            placed = chunks_to_sample(placed, sample)
        metadata = session_metadata(self.stored_headers()).select("session", "key_names", "file_fps")
        chunks = with_side(placed.join(metadata, "session"), self.split)
        rows = read_frames(chunks, arrays, keep=["key_names", "side", "n_frames", "file_fps"],
                           gameplay_filter=gameplay_filter, crop=crop)
        return rows if sample is None else even_sample(rows, sample)

    def serve(self, request: DataFrame, image="full", in_order: bool = False) -> DataFrame:
        """(pos, session, frame_idx, image, action) for each row (pos, session, frame_idx) of ``request``.

        ``image`` chooses the input: full, centre, radar or a rectangle. Every request is
        answered exactly once, a frame asked for twice twice; one that doesn't exist fails
        the job. If minimaps are asked for, all requested sessions without them are named
        in one error before any chunk is read. ``in_order`` gives the rows in the order of
        ``pos``, at the price of decoding a chunk for each batch that needs it.
        """
        source, _ = resolve_input(image)
        if source == "radar":
            asked = self.sessions.join(request.select("session"), "session", "left_semi")
            require_radar(asked, self.stored_headers())
        own = self.stored_headers().join(request.select("session"), "session", "left_semi")
        placed = written(replace(self, headers=own).checked_chunks([source]), "chunks")
        serve = serve_in_order if in_order else serve_by_chunk
        rows = serve(request, placed, image, ["keys", "lclick", "rclick", "dx", "dy"])
        return rows.select("pos", "session", "frame_idx", "image", action_vector().alias("action"))

    def balanced(self, fraction: float = PROBE_HOLDOUT_FRACTION) -> Dataset:
        """The same sessions under the frame-balanced split."""
        lengths = counted_frames(self.headers).withColumnRenamed("n_counted", "n_frames")
        return replace(self, split=balanced_split(lengths, fraction))

    def side(self, name: str) -> Dataset:
        """The same dataset restricted to one side; other sessions' files are never opened."""
        sessions = on_side(self.sessions, self.split, name)
        headers = read_headers(listed_chunks(sessions))
        return Dataset(sessions, self.split, headers, session_metadata(headers))


def open_recordings(spark: SparkSession, root: str, holdout_fraction: float = HOLDOUT_FRACTION,
                    manual: list[str] | None = None) -> Dataset:
    """Discover, judge and split the sessions under ``root``. The folder is listed here, once, and the list kept as a table."""
    sessions = written(usable_sessions(scan_sessions(spark, root)), "sessions")
    headers = read_headers(listed_chunks(sessions))
    return Dataset(sessions, split_sessions(sessions, holdout_fraction, manual), headers, session_metadata(headers))


def window_key_balance(frames: DataFrame, keys: list[str] = PROBE_KEYS, length: int = WINDOW_FRAMES,
                       gameplay_filter: bool = True, keep_mask: bool = False) -> DataFrame:
    """Held fraction of each key per side over clean windows.

    ``frames`` carries keys, key_names and side; filtering comes before windowing,
    so a window never spans a dropped frame.
    """
    served = gameplay(frames, gameplay_filter, keep_mask)
    narrow = served.select("session", "frame_idx", "side", *key_columns(keys))
    return key_balance(sliding_windows(narrow, length), keys, ["side"])


def run_probe(features: DataFrame, lengths: DataFrame | None, keys: list[str] = PROBE_KEYS,
              fraction: float = PROBE_HOLDOUT_FRACTION, balanced: bool = False,
              filter_blank: bool = False, hash_name: str = "blake2b") -> dict[str, DataFrame]:
    """Is there a linear movement signal in the minimap?

    ``features`` holds (session, frame_idx, variance, features, k_<key>...), already
    materialized; ``lengths`` (session, n_frames). Features that bring their ``side``
    (from a dataset's frames) keep it, and are not joined by session again.
    """
    if "side" in features.columns:
        rows, split = features, features.select("session", "side").distinct()
    else:
        split = (balanced_split(lengths, fraction) if balanced
                 else split_sessions(lengths, fraction, hash_name=hash_name))
        rows = with_side(features, split)
    if filter_blank:
        # One cut for both sides.
        rows = above_threshold(rows, pooled_cut(features).select("threshold").scalar())
    rows = written(rows, "probe")
    sides = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sides) < 2:
        raise ValueError(f"the probe needs frames on both sides, got {sides}")
    train = rows.where("side = 'train'")
    scaled, scaling = probe.probe_features(train)
    train_x = written(scaled.drop("features"), "train")
    models, fit = probe.fit_keys(train_x, keys)
    pred = probe.predict_keys(probe.scale(rows, scaling), models, keys)
    lifts = evaluate.key_lift(pred, keys, baseline_from="same")
    converged = fit.agg(F.bool_and("converged").alias("c")).scalar()
    n_sessions = split.agg(F.count(F.lit(1)).alias("n")).scalar()
    verdict = evaluate.probe_verdict(lifts, F.lit(sum(sides.values())), n_sessions, converged)
    return {"fit": fit, "predictions": pred, "lift": lifts, "verdict": verdict, "scaled": probe.scale(rows, scaling),
            "weights": probe.key_weights(train_x.sparkSession, models)}


def run_baseline(frames: DataFrame, split: DataFrame, keys: list[str] = MOVEMENT_KEYS,
                 length: int = WINDOW_FRAMES, times: int = 1) -> dict[str, DataFrame]:
    """The movement baseline: one linear model per key and look axis on window features.

    ``frames`` holds (session, frame_idx, features, dx, dy, k_<key>...), after the
    filters. Statistics and eventful flags come from TRAIN only; evaluation rows are
    never oversampled.
    """
    windows = with_side(probe.window_features(sliding_windows(frames, length, gather=["features"])), split)
    windows = written(windows, "windows")
    train = windows.where("side = 'train'")
    stats = written(look_balance(train), "look")
    balance = key_balance(windows, keys, ["side"])
    volume = split_volume(frames, windows, split)
    scaling = written(probe.feature_scale(train), "scaling")
    fit_rows = oversample(flag_eventful(train, keys), times) if times > 1 else train
    row = stats.agg(F.struct(*[F.first(c).alias(c) for c in ("dx_mean", "dx_std", "dy_mean", "dy_std")]).alias("s")).scalar()
    fit_rows = fit_rows.withColumn("_st", row)
    for a in ("dx", "dy"):
        fit_rows = fit_rows.withColumn(f"{a}_z", standardize(
            F.col(a).cast("double"), F.col(f"_st.{a}_mean"), F.col(f"_st.{a}_std")))
    # MLlib keeps its own copy while it iterates; each fit reads this table once.
    fit_rows = written(probe.scale(fit_rows, scaling).drop("features", "_st"), "train")
    key_models, fit = probe.fit_keys(fit_rows, keys, tol=1e-6)
    look_models = probe.fit_look(fit_rows)
    pred = probe.predict_look(probe.predict_keys(probe.scale(windows, scaling), key_models, keys), look_models)
    pred = pred.select("session", "last_idx", "side", "probs", "truth", "look_pred", "look_true")
    lifts = evaluate.key_lift(pred, keys, baseline_from="train")
    return {"balance": balance, "look_stats": stats, "fit": fit, "predictions": pred, "lift": lifts,
            "mean_lift": evaluate.mean_lift(lifts), "look": evaluate.look_error(pred, stats), "fit_rows": fit_rows,
            "weights": probe.key_weights(fit_rows.sparkSession, key_models),
            "verdict": evaluate.baseline_verdict(volume)}


def diagnose(windows: DataFrame, score: Callable[[DataFrame], DataFrame], keys: list[str],
             stats: DataFrame | None = None, sample: int = 2000,
             threshold: float = PRESS_THRESHOLD) -> dict[str, DataFrame]:
    """What a model predicts on a fixed-stride sample of windows.

    ``score`` adds probs, truth, look_pred and look_true: a fitted model's transform,
    or a pandas UDF around any other model.
    """
    pred = written(score(stride_sample(windows, sample)), "predictions")
    return {"keys": evaluate.confusion(pred, keys, threshold), "look": evaluate.look_collapse(pred, stats),
            "turns": evaluate.hardest_turns(pred, stats)}


def score_windows(windows: DataFrame, load: Callable[[], Callable], keys: list[str], features: str = "features",
                  batch_size: int = 64, width: int | None = None) -> DataFrame:
    """Add what any model predicts for each window: probs, look_pred, truth and look_true.

    ``load`` runs once in each Python worker and returns a function from a (rows, width)
    array to (rows, keys + 2) predictions: a probability for each key, then dx and dy. Rows go
    through it in batches beside the scan. ``windows`` holds the features, k_<key> columns, dx and dy.
    """
    def make() -> Callable:
        model = load()
        return lambda x: np.asarray(model(np.asarray(x, dtype=np.float64)), dtype=np.float64)
    shapes = [[width]] if width else None
    predict = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=shapes)
    scored = windows.withColumn("_y", predict(features))
    n = len(keys)
    return scored.select(
        *windows.columns, F.slice("_y", 1, n).alias("probs"), F.slice("_y", n + 1, 2).alias("look_pred"),
        F.array(*[F.col(f"k_{k}").cast("int") for k in keys]).alias("truth"),
        F.array(F.col("dx").cast("double"), F.col("dy").cast("double")).alias("look_true"))


def replay_policy(pred: DataFrame, keys: list[str], stats: DataFrame | None = None,
                  threshold: float = PRESS_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """What a policy would have done: key events and mouse steps, as tables only."""
    held = pred.select("session", F.col("last_idx").alias("frame_idx"),
                       pressed_keys("probs", keys, threshold).alias("held"))
    out = pred.select("session", F.col("last_idx").alias("frame_idx"), "look_pred")
    if stats is not None:
        row = stats.agg(F.struct(*[F.first(c).alias(c) for c in ("dx_mean", "dx_std", "dy_mean", "dy_std")])
                        .alias("s")).scalar()
        out = out.withColumn("_s", row)
    for i, a in enumerate(("dx", "dy")):
        raw = F.get("look_pred", F.lit(i)).cast("double")
        if stats is not None:
            raw = unstandardize(raw, F.col(f"_s.{a}_mean"), F.col(f"_s.{a}_std"))
        out = out.withColumn(a, mouse_step(raw))
    moves = out.select("session", "frame_idx", "dx", "dy").where("dx <> 0 OR dy <> 0")
    return key_edges(held, keys), moves
