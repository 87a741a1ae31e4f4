"""Pixel features, the pooled cut, cleaning, probe and baseline against NumPy."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from replaylens.functions import pixels
from replaylens.functions.actions import key_columns
from replaylens.operators import evaluate, probe, threshold, validate
from replaylens.operators.split import split_sessions
from replaylens.plans import inspection, training
from replaylens.plans.cleaning import NotBimodal, clean
from replaylens.session import written
from replaylens.sources import chunks
from replaylens.sources.manifests import session_sizes
from replaylens.sources.masks import read_mask


def image_rows(spark, images, session="s"):
    rows = [(session, i, bytearray(x.tobytes())) for i, x in enumerate(images)]
    return spark.createDataFrame(rows, "session STRING, frame_idx LONG, radar BINARY")


def test_input_choices():
    assert pixels.resolve_input("full") == ("frames", None) and pixels.resolve_input("radar") == ("radar", None)
    assert pixels.resolve_input("centre") == ("frames", (27, 55, 96, 160))
    assert pixels.input_shape((0, 0, 10, 20)) == (10, 20)
    for bad in ("left", (0, 0, 151, 10), (-1, 0, 5, 5), (1, 2, 3)):
        with pytest.raises(ValueError):
            pixels.resolve_input(bad)


@pytest.mark.parametrize("hw, size", [((128, 128), 32), ((10, 14), 4)])
def test_features_match_numpy(spark, hw, size):
    img = np.random.default_rng(0).integers(0, 256, (20, *hw, 3), dtype=np.uint8)
    got = pixels.radar_features(image_rows(spark, img).repartition(3), ["frame_idx"], hw=hw, size=size).orderBy("frame_idx").collect()
    gray = img.astype(np.float32).mean(axis=3)
    assert np.allclose([r["variance"] for r in got], gray.reshape(20, -1).var(axis=1), rtol=1e-5)
    ys, xs = np.linspace(0, hw[0], size + 1).astype(int), np.linspace(0, hw[1], size + 1).astype(int)
    want = [[gray[i, ys[a]:ys[a + 1], xs[b]:xs[b + 1]].mean() / 255 for a in range(size) for b in range(size)] for i in range(20)]
    assert np.allclose([r["features"] for r in got], want, atol=1e-6)
    wrong = image_rows(spark, img[:, :-1])
    with pytest.raises(Exception, match="image column must hold"):
        pixels.radar_variance(wrong, ["frame_idx"], hw=hw).collect()


def test_pixel_sample_and_upscale(spark):
    img = np.random.default_rng(1).integers(0, 256, (120, 4, 4, 3), dtype=np.uint8)
    row = inspection.pixel_sample(image_rows(spark, img), "radar", (4, 4)).first()
    pick = img[np.linspace(0, 119, 50).astype(int)]
    assert (row["radar_min"], row["radar_max"]) == (pick.min(), pick.max()) and row["radar_mean"] == pytest.approx(pick.mean())
    big = pixels.upscale_images(image_rows(spark, img[:2]), ["frame_idx"], "radar", (4, 4), 3).orderBy("frame_idx").collect()
    assert bytes(big[1]["image"]) == img[1].repeat(3, 0).repeat(3, 1).tobytes()


def numpy_cut(v):
    lv = np.log10(np.maximum(v, 0) + 1)
    hist, edges = np.histogram(lv, bins=256, range=(lv.min(), lv.max()))
    c = (edges[:-1] + edges[1:]) / 2
    best = max(range(256), key=lambda i: (between(hist, c, i), -i))
    return hist, 10 ** c[best] - 1


def between(hist, c, i):
    a, b = hist[:i + 1].sum() / hist.sum(), hist[i + 1:].sum() / hist.sum()
    if a <= 1e-12 or b <= 1e-12:
        return 0.0
    return round(a * b * (np.average(c[:i + 1], weights=hist[:i + 1]) - np.average(c[i + 1:], weights=hist[i + 1:])) ** 2, 12)


def test_cut_matches_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.exponential(1.0, 400), rng.normal(4000, 600, 1600).clip(1)])
    df = spark.createDataFrame(pd.DataFrame({"variance": v}))
    hist, cut = numpy_cut(v)
    assert [r["n"] for r in threshold.histogram(df).orderBy("bin").collect()] == hist.tolist()
    row = threshold.pooled_cut(df).first()
    assert row["threshold"] == pytest.approx(cut) and row["bimodal"] and row["n_low"] == (v <= cut).sum()
    s = threshold.variance_summary(df).first()
    assert (s["lowest"], s["highest"]) == (v.min(), v.max()) and s["median"] == pytest.approx(np.median(v))
    one = threshold.pooled_cut(spark.createDataFrame([(5.0,)] * 9, "variance DOUBLE")).first()
    assert (one["threshold"], one["bimodal"], one["reason"]) == (0.0, False, "single value")
    none = threshold.pooled_cut(spark.createDataFrame([], "variance DOUBLE")).first()
    assert (none["threshold"], none["bimodal"], none["reason"]) == (0.0, False, "no data")
    single = rng.normal(4000, 300, 2000)
    assert not threshold.pooled_cut(spark.createDataFrame(pd.DataFrame({"variance": single}))).first()["bimodal"]


def test_clean_writes_masks_only_when_bimodal(spark, tmp_path):
    rng = np.random.default_rng(4)
    busy = rng.integers(0, 256, (40, 8, 8, 3), dtype=np.uint8)
    blank = np.full((10, 8, 8, 3), 30, np.uint8)
    both = image_rows(spark, np.concatenate([busy, blank])).unionByName(image_rows(spark, busy, "only_busy"))
    path = str(tmp_path / "mask")
    report = {r["session"]: (r["kept"], r["dropped"]) for r in clean(spark, both, path, hw=(8, 8)).collect()}
    assert report == {"s": (40, 10), "only_busy": (40, 0)}
    assert read_mask(spark, path).where("NOT keep").count() == 10
    with pytest.raises(NotBimodal):
        clean(spark, image_rows(spark, busy), str(tmp_path / "other"), hw=(8, 8))
    assert read_mask(spark, str(tmp_path / "other")).count() == 0
    clean(spark, image_rows(spark, busy), str(tmp_path / "other"), force=True, hw=(8, 8))
    assert read_mask(spark, str(tmp_path / "other")).count() == 40


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(6):
        for i in range(120):
            x = rng.normal(size=5)
            rows.append((f"s{s}", i, 1.0, x.tolist(), int(x[0] + 0.2 * rng.normal() > 0), int(rng.random() < 0.1), 1, 0))
    return spark.createDataFrame(rows, "session STRING, frame_idx LONG, variance DOUBLE, features ARRAY<DOUBLE>, "
                                       "k_w INT, k_a INT, k_s INT, k_d INT")


def test_scaling_and_converged_fit(spark, labelled):
    x = np.array([r["features"] for r in labelled.orderBy("session", "frame_idx").collect()])
    y = np.array([r["k_w"] for r in labelled.orderBy("session", "frame_idx").collect()])
    scaled, scaling = probe.probe_features(labelled)
    row = scaling.first()
    assert np.allclose(row["mean"], x.mean(0)) and np.allclose(row["std"], x.std(0))
    models, fit = probe.fit_keys(scaled, ["w", "s"])
    assert all(r["converged"] for r in fit.collect()) and models["s"] == 1.0
    z, n = (x - x.mean(0)) / x.std(0), len(x)
    w, b = np.zeros(5), 0.0
    for _ in range(20000):  # plain descent on the same objective, to convergence
        g = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.5 * (z.T @ g / n + 5.0 * w / n), b - 0.5 * g.mean()
    assert np.allclose(models["w"].coefficients.toArray(), w, atol=1e-4) and models["w"].intercept == pytest.approx(b, abs=1e-4)


def test_probe_finds_the_signal(spark, labelled):
    lengths = labelled.groupBy("session").agg(F.count("*").alias("n_frames"))
    out = training.run_probe(labelled, lengths, balanced=True)
    lift = {(r["side"], r["key"]): r["lift"] for r in out["lift"].collect()}
    assert lift["holdout", "w"] > 0.3 and abs(lift["holdout", "s"]) < 1e-9
    assert out["verdict"].first()["verdict"] == "SIGNAL (provisional)"


def test_baseline_and_replay(spark, labelled):
    frames = labelled.withColumn("dx", (F.get("features", F.lit(1)) * 40).cast("int")).withColumn("dy", F.lit(3))
    for k in ("shift", "space"):
        frames = frames.withColumn(f"k_{k}", F.lit(0))
    split = split_sessions(labelled.select("session").distinct(), manual=["s0", "s1"], fraction=0.0)
    out = training.run_baseline(frames.drop("variance"), split, length=3, times=2)
    lifts = {(r["side"], r["key"]): r["acc"] for r in out["lift"].collect()}
    assert lifts["train", "w"] > 0.6
    assert out["verdict"].first()["verdict"] == "PROVISIONAL"
    look = {(r["side"], r["axis"]): r for r in out["look"].collect()}
    assert look["holdout", "dx"]["improve"] > 0 and look["holdout", "dy"]["mae"] == pytest.approx(0, abs=1e-6)
    assert out["predictions"].where("side = 'train'").count() == 4 * 118
    edges, moves = training.replay_policy(out["predictions"], ["w", "a", "s", "d", "shift", "space"], out["look_stats"])
    assert edges.where("event = 'press' AND key = 's'").count() == 6
    assert moves.where("dy <> 3").count() == 0


def test_diagnosis_of_any_scorer(spark, labelled):
    windows = labelled.withColumnRenamed("frame_idx", "last_idx")

    @F.pandas_udf("double")
    def prob(x: pd.Series) -> pd.Series:
        return x.map(lambda v: float(v[0] > 0))

    def score(df):
        return df.select("session", "last_idx", F.array(prob("features")).alias("probs"), F.array("k_w").alias("truth"),
                         F.array(F.lit(0.0), F.lit(0.0)).alias("look_pred"), F.slice("features", 1, 2).alias("look_true"))
    out = training.diagnose(windows, score, ["w"], sample=300)
    row = out["keys"].first()
    assert row["n"] == 300 and row["precision"] > 0.8 and row["recall"] > 0.8
    assert all(r["collapsed"] for r in out["look"].collect()) and out["turns"].count() == 8


def test_verdicts(spark):
    def verdict(lift, frames=30_000, sessions=4, converged=True):
        lifts = spark.createDataFrame([("holdout", lift)], "side STRING, lift DOUBLE")
        return evaluate.probe_verdict(lifts, F.lit(frames), F.lit(sessions), F.lit(converged)).first()["verdict"]
    assert verdict(0.031) == "SIGNAL" and verdict(0.03) == "FLAT" and verdict(-0.05) == "FLAT"
    assert verdict(-0.051).startswith("NO RESULT") and verdict(0.5, converged=False).startswith("NO RESULT")
    assert verdict(0.1, frames=19_999) == "SIGNAL (provisional)" and verdict(0.0, sessions=2) == "FLAT (provisional)"
    def base(rows):
        return evaluate.baseline_verdict(spark.createDataFrame(rows, "side STRING, n_sessions LONG, n_windows LONG")).first()["verdict"]
    assert base([("train", 3, 15_000), ("holdout", 1, 10)]) == "COMMITTED"
    assert base([("train", 3, 14_999), ("holdout", 1, 10)]) == "PROVISIONAL"
    assert base([("train", 3, 20_000)]) == "NO GENERALISATION MEASURED"


def test_constant_look_has_no_correlation(spark):
    rows = [("s", i, "train", [0.5], [1], [0.0, 1.0], [float(i), 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "session STRING, last_idx LONG, side STRING, probs ARRAY<DOUBLE>, truth ARRAY<INT>, "
                                     "look_pred ARRAY<DOUBLE>, look_true ARRAY<DOUBLE>")
    got = {r["axis"]: r for r in evaluate.look_collapse(df).collect()}
    assert np.isnan(got["dx"]["corr"]) and got["dx"]["collapsed"]
    with pytest.raises(ValueError):
        evaluate.key_lift(df, ["w"], "other")


def test_flagship_on_recordings(spark, recordings):
    recordings.folder("a", [12], 5, seed=3)
    recordings.folder("b", [9], 5, seed=4)
    data = training.open_recordings(spark, recordings.root, manual=["b"], holdout_fraction=0.0)
    got = {r["side"]: r for r in training.window_key_balance(
        data.frames(["keys", "alive", "round_phase"]), ["w"], 2).collect()}
    for side, name in (("train", "a"), ("holdout", "b")):
        ok = (recordings.joined(name, "alive") == 1) & (recordings.joined(name, "round_phase") != "freezetime")
        ends = [i for i in range(1, len(ok)) if ok[i] and ok[i - 1]]
        if ends:
            assert got[side]["n_windows"] == len(ends)
            assert got[side]["held_w"] == pytest.approx(recordings.joined(name, "keys")[ends, 0].mean())
        else:
            assert side not in got
    assert key_columns(["w"])
    holdout = data.side("holdout")
    assert {r["session"] for r in holdout.frames(["dx"]).collect()} == {"b"}


def test_sampling_opens_only_needed_chunks(spark, recordings):
    recordings.folder("long", [6, 6, 6], 3)
    recordings.folder("short", [3], 3)
    data = training.open_recordings(spark, recordings.root)
    placed = chunks.place_chunks(data.headers)
    assert sorted((r["session"], r["chunk_idx"]) for r in chunks.chunks_to_sample(placed, 2).collect()) == [
        ("long", 0), ("long", 2), ("short", 0)]
    got = data.frames(["radar"], sample=2)
    assert sorted((r["session"], r["frame_idx"]) for r in got.collect()) == [("long", 0), ("long", 17), ("short", 0), ("short", 2)]
    sampled = inspection.pixel_sample(data.frames(["radar"], sample=2), "radar", (128, 128), 2)
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan.split("MapInArrow")[0]  # joins of chunks only, below the decoding
    radar = recordings.joined("long", "radar")[[0, 17]]
    assert sampled.where("session = 'long'").first()["radar_mean"] == pytest.approx(radar.mean())


def test_probe_on_recordings(spark, recordings):
    rng = np.random.default_rng(0)

    def signal(i, arrays):
        w = arrays["keys"][:, 0].astype(bool)
        arrays["radar"] = rng.integers(0, 60, arrays["radar"].shape, dtype=np.uint8)
        arrays["radar"][w, :64, :64] += 150
    for i, n in enumerate((30, 24, 20)):
        recordings.folder(f"s{i}", [n], 3, seed=i + 1, change=signal)
    data = training.open_recordings(spark, recordings.root).balanced()
    frames = data.frames(["radar", "keys"]).select("session", "frame_idx", "side", "radar", *key_columns(["w", "a"]))
    feats = written(pixels.radar_features(frames, ["session", "frame_idx", "side", "k_w", "k_a"], size=8), "features")
    out = training.run_probe(feats, None, ["w", "a"], balanced=False)
    lift = {(r["side"], r["key"]): r["acc"] for r in out["lift"].collect()}
    assert lift["holdout", "w"] == 1.0
    assert {r["side"] for r in out["predictions"].select("side").distinct().collect()} == {"train", "holdout"}


def test_full_inspection(spark, recordings):
    recordings.folder("a", [7, 5], 5, seed=3)
    recordings.file("old", 4)
    data = training.open_recordings(spark, recordings.root)
    sizes = session_sizes(spark, recordings.root, data.sessions)
    versions = data.sessions.select("session", "is_folder", "schema_version").join(data.metadata, "session").select(
        "session", validate.kind_label(F.coalesce("schema_version", "file_version"), F.col("is_folder")).alias("kind"))
    rows = {r["session"]: r for r in inspection.inspection(
        data.sessions, validate.header_alignment(data.headers), sizes, data.frames(), versions).collect()}
    a, t = rows["a"], recordings.joined("a", "timestamps")
    gaps = np.diff(t)
    assert a["fps"] == pytest.approx(1 / gaps.mean()) and a["jitter_ms"] == pytest.approx(gaps.std() * 1000)
    assert (a["frames"], a["boundaries"], a["aligned"], a["kind"][:2]) == (12, 1, True, "v5")
    alive = recordings.joined("a", "alive")
    assert a["n_alive"] == alive.sum() and a["alive_flips"] == np.count_nonzero(np.diff(alive.astype(int)))
    health = recordings.joined("a", "health")[alive > 0]
    assert (a["health_n"], a["health_min"]) == (len(health), health.min() if len(health) else None)
    assert rows["old"]["kind"] == "v1 single file" and rows["old"]["health_n"] == 0
    assert json.loads(a["report"])["session"] == "a"
