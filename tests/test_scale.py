"""What would grow faster than its input, or cost a call for each session: listings, packed pictures and stream state."""

from __future__ import annotations

import io
import os

import numpy as np
from pyspark.sql import functions as F

from catalog import stored
from catalog.queries import _thousandths
from replaylens.functions.pixels import crop_images
from replaylens.plans.training import open_recordings
from replaylens.sources import manifests
from replaylens.streaming import state_stream


def test_discovery_lists_in_a_task(spark, tmp_path, monkeypatch):
    """Neither pattern nor paths pass the driver of a mounted folder; odd names and files are told apart."""
    monkeypatch.setattr(manifests, "_spark_candidates", None)
    for name in ("a b%c", "two"):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "manifest.json").write_text('{"chunks": ["x.npz"], "complete": true, "total_frames": 3}')
    os.makedirs(tmp_path / "without")
    for name in ("bare.npz", "_hidden.npz", ".tmp.npz", "note.txt"):
        (tmp_path / name).write_bytes(b"")
    found = {r["session"]: r for r in manifests.scan_sessions(spark, str(tmp_path)).collect()}
    assert {k: r["is_folder"] for k, r in found.items()} == {"a%20b%25c": True, "two": True, "bare": False}
    assert found["two"]["total_frames"] == 3 and found["two"]["reason"] is None
    assert found["two"]["path"] == f"file://{tmp_path}/two"


def test_packed_pictures_are_an_npz():
    """Pictures packed once each make the arrays that NumPy reads, checksums included."""
    values = [1, 100, 1, 255]
    data = stored._npz({"frames": stored._pictures(values, (15, 27)), "keys": stored._array(np.arange(6).reshape(2, 3)),
                        "geom": stored._array(np.array("generated"))})
    with np.load(io.BytesIO(data)) as z:
        assert z["frames"].shape == (4, 15, 27, 3) and z["keys"].tolist() == [[0, 1, 2], [3, 4, 5]] and str(z["geom"]) == "generated"
        assert (z["frames"] == np.array(values, np.uint8).reshape(-1, 1, 1, 1)).all()
        assert z.zip.testzip() is None


def test_crop_in_the_decoder_equals_crop_of_frames(spark, recordings):
    recordings.folder("s5", [30, 1, 9], 5)
    recordings.file("old", 8, seed=3)
    data = open_recordings(spark, recordings.root)
    digest = lambda df, c: {(r[0], r[1]): r[2] for r in df.select("session", "frame_idx", F.sha2(c, 256)).collect()}
    inside = digest(data.frames(["frames", "dx"], crop="centre"), "frames")
    assert inside and inside == digest(crop_images(data.frames(["frames"]), "centre", ["session", "frame_idx"]), "image")


def test_sessions_share_groups(spark):
    """State is called for a fixed number of groups, however many sessions there are."""
    groups = spark.range(50_000).select(state_stream.group_of(F.col("id").cast("string")).alias("g"))
    assert groups.distinct().count() <= state_stream.GROUPS


def test_feature_cells_round_ties_up(spark):
    """All sums a cell can have, as the single-precision feature they give; 153 is 12.5 thousandths."""
    sums = np.arange(12241)
    features = (sums / 48 / 255).astype(np.float32)
    rows = spark.createDataFrame([(int(s), float(x)) for s, x in zip(sums, features)], "s INT, x DOUBLE").select("s", F.col("x").cast("float"))
    got = {r["s"]: r["cell"] for r in rows.select("s", _thousandths(F.col("x")).alias("cell")).collect()}
    assert got == {int(s): int((2000 * s + 12240) // 24480) for s in sums} and got[153] == 13
