"""Masks and frames as replaceable tables, stored reports, file sizes, scoring by any model, and gradients."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from replaylens.operators import probe
from replaylens.plans import cleaning, training
from replaylens.sources import manifests, masks, tables


def test_masks_are_replaced_together(spark, tmp_path):
    path = str(tmp_path / "masks")
    rows = [(s, i, i % 2 == 0, float(i), 1.5, 4) for s in ("a", "b", "c") for i in range(4)]
    mask = spark.createDataFrame(rows, masks.MASK_SCHEMA)
    masks.write_mask(mask, path)
    masks.write_mask(masks.rethreshold(mask.where("session <> 'b'"), 0.5).where("frame_idx < 3"), path)
    got = {}
    for r in masks.read_mask(spark, path).collect():
        got.setdefault(r["session"], []).append((r["frame_idx"], r["keep"]))
    assert {s: sorted(x) for s, x in got.items()} == {
        "a": [(0, False), (1, True), (2, True)], "b": [(i, i % 2 == 0) for i in range(4)], "c": [(0, False), (1, True), (2, True)]}
    assert not any("session=" in d for d, _, _ in os.walk(path))  # no folder for each session


def test_frames_of_some_sessions_are_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "frames"), "session STRING, frame_idx LONG, dx INT, chunk_idx INT"
    frames = spark.createDataFrame([(s, i, i) for s in "ab" for i in range(7)], "session STRING, frame_idx LONG, dx INT")
    tables.replace_sessions(frames, path, 3)
    tables.replace_sessions(frames.where("session = 'a' and frame_idx < 4").withColumn("dx", F.col("dx") * 10), path, 3)
    got = tables.read_sessions(spark, path, schema)
    assert sorted(map(tuple, got.collect())) == [("a", i, 10 * i, i // 3) for i in range(4)] + [("b", i, i, i // 3) for i in range(7)]
    assert tables.read_sessions(spark, path, schema, "b").count() == 7
    assert tables.read_sessions(spark, path, schema, "nobody").count() == 0


def test_clean_stores_its_report(spark, recordings, tmp_path):
    recordings.folder("s", [6, 4], 3, change=lambda i, a: a["radar"].__setitem__(slice(0, 2), 7))
    recordings.folder("t", [5], 3, seed=2)
    frames = training.open_recordings(spark, recordings.root).frames(["radar"])
    report = cleaning.clean(spark, frames, str(tmp_path / "masks"), report_path=str(tmp_path / "report"))
    stored = {}
    for name in os.listdir(tmp_path / "report"):
        if name.endswith(".json"):
            for line in open(tmp_path / "report" / name):
                row = json.loads(line)
                stored[row.pop("session")] = row
    assert stored["s"]["chunk_lengths"] == [6, 4] and stored["t"]["chunk_lengths"] == [5]
    assert (stored["s"]["total_frames"], stored["s"]["kept"], stored["s"]["dropped"]) == (10, 6, 4)
    assert stored["s"]["dropped_frac"] == 0.4 and stored["t"]["dropped"] == 0 and stored["s"]["mask_schema"] == 1
    assert {r["session"]: r["kept"] for r in report.collect()} == {"s": 6, "t": 5}
    variance = spark.createDataFrame([("s", i, 0.0 if i < 3 else 900.0 + i) for i in range(10)], "session STRING, frame_idx LONG, variance DOUBLE")
    figures, histogram = cleaning.preview(variance)
    row = figures.first()
    assert (row["n"], row["n_sessions"], row["n_blank"], row["n_kept"], row["bimodal"], row["highest"]) == (10, 1, 3, 7, True, 909.0)
    assert histogram.count() == 12 and histogram.agg(F.sum("n")).first()[0] == 10


def test_sizes_of_listed_files_only(spark, tmp_path):
    for name, size in (("s/a.npz", 10), ("s/b.npz", 20), ("s/stray.npz", 4000)):
        os.makedirs(tmp_path / "s", exist_ok=True)
        (tmp_path / name).write_bytes(bytes(size))
    sessions = spark.createDataFrame([("s", f"file://{tmp_path}/s", True, 3, ["a.npz", "b.npz", "gone.npz"]), ("e", "x", True, 5, [])],
                                     "session STRING, path STRING, is_folder BOOLEAN, bytes LONG, chunks ARRAY<STRING>")
    got = {r["session"]: r["total_bytes"] for r in manifests.session_sizes(spark, str(tmp_path), sessions).collect()}
    assert got == {"s": 33, "e": 5}


def test_any_model_scores_windows(spark):
    def load():
        def predict(x):
            assert x.ndim == 2 and len(x) <= 5
            return np.stack([x[:, 0], 1 - x[:, 0], x[:, 1] * 2, x[:, 1] - 1], axis=1)
        return predict
    rows = [("s", i, [i / 10, float(i)], i % 2, 1, i, -i) for i in range(11)]
    df = spark.createDataFrame(rows, "session STRING, last_idx LONG, features ARRAY<FLOAT>, k_w INT, k_a INT, dx INT, dy INT")
    got = training.score_windows(df.repartition(2), load, ["w", "a"], batch_size=5, width=2).orderBy("last_idx").collect()
    for i, r in enumerate(got):
        assert list(r["probs"]) == pytest.approx([i / 10, 1 - i / 10]) and list(r["look_pred"]) == [2 * i, i - 1]
        assert list(r["truth"]) == [i % 2, 1] and list(r["look_true"]) == [i, -i]


def test_gradient_of_the_penalised_loss(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    w, b = np.array([0.3, -0.2, 0.0]), 0.1
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y)], "f ARRAY<DOUBLE>, k_w INT")
    from pyspark.ml.functions import array_to_vector
    weights = spark.createDataFrame([("w", w.tolist(), b)], "key STRING, weights ARRAY<DOUBLE>, intercept DOUBLE")
    got = {r["at"]: r["gradient"] for r in probe.objective_gradient(df.withColumn("x", array_to_vector("f")), weights, 2.0).collect()}
    miss = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert got[-1] == pytest.approx(miss.mean())
    assert [got[j] for j in range(3)] == pytest.approx((x.T @ miss / 60 + 2.0 * w / 60).tolist())
