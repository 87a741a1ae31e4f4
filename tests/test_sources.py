"""Discovery, chunk reading, masks and tables on generated recordings."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from replaylens.functions.actions import action_layout, action_vector
from replaylens.functions.pixels import crop_images
from replaylens.operators import validate
from replaylens.operators.frames import even_sample
from replaylens.plans.training import open_recordings
from replaylens.sources import chunks, manifests, masks, tables


def scan(spark, rec):
    return manifests.scan_sessions(spark, rec.root)


def headers(spark, rec):
    return chunks.read_headers(manifests.listed_chunks(manifests.usable_sessions(scan(spark, rec))), tasks=4)


def frames(spark, rec, arrays=None):
    return chunks.read_frames(chunks.place_chunks(headers(spark, rec)), arrays, tasks=4)


def test_discovery_and_skips(spark, recordings):
    recordings.file("session_v1", 3)
    recordings.folder("session_v2", [2, 2], 2)
    recordings.folder("session_open", [2], 3, complete="absent")
    recordings.folder("session_crashed", [2], 2, complete=False, chunks=[])
    recordings.folder("session_empty", [2], 2, chunks=[])
    os.makedirs(os.path.join(recordings.root, "session_bad"))
    with open(os.path.join(recordings.root, "session_bad", "manifest.json"), "w") as f:
        f.write("{not json")
    os.makedirs(os.path.join(recordings.root, "no_manifest"))
    all_ = scan(spark, recordings)
    ok = {r["session"] for r in manifests.usable_sessions(all_).collect()}
    assert ok == {"session_v1", "session_v2", "session_open"}
    skipped = {r["session"]: r["reason"] for r in manifests.skipped_sessions(all_).collect()}
    assert skipped == {"session_crashed": manifests.INCOMPLETE, "session_empty": manifests.EMPTY,
                       "session_bad": manifests.UNREADABLE}
    assert manifests.pick_sessions(all_, "session_v1.npz").count() == 1
    later = os.path.getmtime(os.path.join(recordings.root, "session_v1.npz")) + 100
    os.utime(os.path.join(recordings.root, "session_v2", "manifest.json"), (later, later))
    assert manifests.newest_session(scan(spark, recordings)).first()["session"] == "session_v2"


def test_missing_folder_is_empty(spark, tmp_path):
    assert manifests.scan_sessions(spark, str(tmp_path / "none")).count() == 0


def test_rows_equal_stored_arrays_in_manifest_order(spark, recordings):
    recordings.folder("s5", [4, 3, 2], 5, order=[1, 0, 2])
    with open(os.path.join(recordings.root, "s5", "chunk_00009.tmp.npz"), "wb") as f:
        f.write(b"unfinished")
    got = frames(spark, recordings, chunks.SCALAR_ARRAYS + ["radar"]).orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in got] == list(range(9))
    assert [r["chunk_idx"] for r in got] == [0] * 3 + [1] * 4 + [2] * 2
    for name in ("lclick", "rclick", "dx", "dy", "alive", "round_phase", "health", "active_weapon",
                 "ammo_clip", "ammo_reserve"):
        assert [r[name] for r in got] == recordings.joined("s5", name).tolist(), name
    assert [r["t"] for r in got] == recordings.joined("s5", "timestamps").tolist()
    assert [list(r["keys"]) for r in got] == recordings.joined("s5", "keys").tolist()
    radar = recordings.joined("s5", "radar")
    assert all(bytes(r["radar"]) == radar[i].tobytes() for i, r in enumerate(got))


def test_older_versions_have_null_columns(spark, recordings):
    recordings.file("v1", 3)
    recordings.folder("v2", [2, 1], 2)
    recordings.folder("v5", [3], 5)
    n = {r["session"]: (r["a"], r["h"], r["n"]) for r in frames(spark, recordings).groupBy("session").agg(
        F.count("alive").alias("a"), F.count("health").alias("h"), F.count("*").alias("n")).collect()}
    assert n == {"v1": (0, 0, 3), "v2": (0, 0, 3), "v5": (3, 3, 3)}
    meta = {r["session"]: (r["file_version"], list(r["key_names"])[:4]) for r in
            chunks.session_metadata(headers(spark, recordings)).collect()}
    assert meta["v1"] == (1, ["w", "a", "s", "d"]) and meta["v5"][0] == 5


def test_unread_arrays_are_not_opened(spark, recordings):
    recordings.folder("s", [3], 3)
    path = os.path.join(recordings.root, "s", "chunk_00000.npz")
    import zipfile
    with zipfile.ZipFile(path) as z:
        members = {n: z.read(n) for n in z.namelist()}
    head = members["frames.npy"][:128]
    members["frames.npy"] = head  # header only: reading the images would fail
    with zipfile.ZipFile(path, "w") as z:
        for n, data in members.items():
            z.writestr(n, data)
    assert frames(spark, recordings, ["dx"]).count() == 3


def test_unknown_version_is_refused(spark, recordings):
    recordings.folder("s", [2], 9)
    assert validate.unsupported_chunks(headers(spark, recordings)).count() == 1
    with pytest.raises(Exception, match="schema_version=9 is not supported"):
        frames(spark, recordings, ["dx"]).collect()


@pytest.mark.parametrize("array", ["dx", "radar"])
def test_misaligned_arrays_are_refused(spark, recordings, array):
    def cut(i, arrays):
        if i == 1:
            arrays[array] = arrays[array][:-2]
    recordings.folder("bad", [3, 4], 3, change=cut)
    recordings.folder("good", [3, 4], 3, seed=2)
    report = {r["session"]: (r["aligned"], list(r["misaligned"])) for r in
              validate.header_alignment(headers(spark, recordings)).collect()}
    assert report == {"bad": (False, [array]), "good": (True, [])}
    assert {r["session"] for r in tables.finished_sessions(
        validate.header_alignment(headers(spark, recordings))).collect()} == {"good"}
    with pytest.raises(Exception, match="differ in length"):
        frames(spark, recordings, ["dy"]).collect()


def test_array_in_some_chunks_only_is_misaligned(spark, recordings):
    recordings.folder("s", [3, 3], 3, change=lambda i, a: a.pop("radar") if i else None)
    row = validate.header_alignment(headers(spark, recordings)).first()
    assert not row["aligned"] and list(row["misaligned"]) == ["radar"]


def test_lengths_and_sizes(spark, recordings):
    recordings.folder("right", [3, 2], 2)
    recordings.folder("wrong", [3, 2], 2, total_frames=9)
    recordings.folder("unsaid", [4], 2, total_frames="absent")
    recordings.file("old", 2)
    sessions = manifests.usable_sessions(scan(spark, recordings))
    got = {r["session"]: (r["n_frames"], r["n_counted"], r["mismatch"]) for r in validate.session_lengths(
        sessions, validate.counted_frames(headers(spark, recordings))).collect()}
    assert got == {"right": (5, 5, False), "wrong": (9, 5, True), "unsaid": (4, 4, False), "old": (2, 2, False)}
    sizes = {r["session"]: r["total_bytes"] for r in manifests.session_sizes(spark, recordings.root, sessions).collect()}
    folder = os.path.join(recordings.root, "right")
    assert sizes["right"] == sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder))
    assert sizes["old"] == os.path.getsize(os.path.join(recordings.root, "old.npz"))
    by_chunk = validate.chunk_lengths(frames(spark, recordings, ["dx"]))
    assert {r["session"]: list(r["chunk_lengths"]) for r in by_chunk.collect()}["right"] == [3, 2]


def test_radar_gate_names_sessions_before_reading(spark, recordings):
    recordings.folder("has", [2], 3)
    recordings.folder("lacks", [2], 2)
    sessions = manifests.usable_sessions(scan(spark, recordings))
    with pytest.raises(ValueError, match="lacks"):
        validate.require_radar(sessions, headers(spark, recordings))
    validate.require_radar(sessions.where("session = 'has'"), headers(spark, recordings))


def test_action_vector_and_crop(spark, recordings):
    recordings.folder("s", [4], 3)
    data = open_recordings(spark, recordings.root, manual=["s"])
    f = data.frames(["keys", "lclick", "rclick", "dx", "dy"])
    rows = f.select("frame_idx", "side", action_vector().alias("y"), action_layout().alias("names")).orderBy("frame_idx").collect()
    want = np.concatenate([recordings.joined("s", "keys"), *[recordings.joined("s", c)[:, None] for c in ("lclick", "rclick", "dx", "dy")]], axis=1)
    assert np.array([r["y"] for r in rows]).tolist() == want.astype(float).tolist()
    assert rows[0]["names"][-4:] == ["lclick", "rclick", "dx", "dy"] and rows[0]["side"] == "holdout"
    images = data.frames(["frames"])
    got = crop_images(images, "centre", ["frame_idx"]).orderBy("frame_idx").collect()
    full = recordings.joined("s", "frames")
    assert all(bytes(r["image"]) == full[i, 27:123, 55:215].tobytes() for i, r in enumerate(got))
    picks = even_sample(f, 3).select("frame_idx").collect()
    assert sorted(r[0] for r in picks) == [0, 1, 3]


def test_masks(spark, recordings, tmp_path):
    recordings.folder("a", [4], 3)
    recordings.folder("b", [4], 3, seed=2)
    recordings.folder("c", [4], 3, seed=3)
    np.savez_compressed(os.path.join(recordings.root, "a", "keep_mask.npz"), keep=np.array([True, False, True, True]),
                        variance=np.array([5, 1, 6, 7], np.float32), threshold=np.float32(2), source_frames=np.array(4))
    np.savez_compressed(os.path.join(recordings.root, "b", "keep_mask.npz"), keep=np.ones(3, bool), source_frames=np.array(3))
    with open(os.path.join(recordings.root, "c", "keep_mask.npz"), "wb") as f:
        f.write(b"garbage")
    sessions = manifests.usable_sessions(scan(spark, recordings))
    stored = masks.read_mask_files(sessions)
    lengths = spark.createDataFrame([("a", 4), ("b", 4), ("c", 4)], "session STRING, n_frames LONG")
    current = masks.current_mask(stored, lengths)
    assert [(r["session"], r["keep"]) for r in current.orderBy("frame_idx").collect()] == [
        ("a", True), ("a", False), ("a", True), ("a", True)]
    out = str(tmp_path / "mask_table")
    assert masks.read_mask(spark, out).count() == 0
    masks.write_mask(current, out)
    again = masks.read_mask(spark, out)
    assert again.count() == 4
    assert masks.rethreshold(again, 5.5).where("keep").count() == 2
    masks.write_mask(current.withColumn("session", F.lit("z")), out)
    assert {r[0] for r in masks.read_mask(spark, out).select("session").distinct().collect()} == {"a", "z"}


def test_frames_table_and_look_stats(spark, recordings, tmp_path):
    recordings.folder("s", [5, 4], 5)
    path = str(tmp_path / "frames")
    tables.write_frames(frames(spark, recordings), path, chunk_frames=4)
    back = tables.read_frames_table(spark, path)
    assert sorted((r["frame_idx"], r["chunk_idx"]) for r in back.collect()) == [(i, i // 4) for i in range(9)]
    plan = back.where("session = 's'").select("dx")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(session" in plan and "ReadSchema: struct<dx:int>" in plan
    stats = spark.createDataFrame([(1.0, 2.0, 0.1, 5.0)], "dx_mean DOUBLE, dy_mean DOUBLE, dx_std DOUBLE, dy_std DOUBLE")
    assert tables.read_look_stats(spark, str(tmp_path / "none")) is None
    tables.write_look_stats(stats, str(tmp_path / "look"))
    assert tables.read_look_stats(spark, str(tmp_path / "look")).first()["dx_std"] == 1.0


def test_manifest_fields(spark, recordings):
    recordings.folder("s", [2], 4)
    row = scan(spark, recordings).withColumn("kind", validate.kind()).first()
    assert row["kind"].startswith("v4") and row["loop_fps_target"] == 15 and json.dumps(row["chunks"])


def test_serving_refuses_what_it_cannot_serve_whole(spark, recordings):
    recordings.folder("fine", [4, 3], 5)
    recordings.folder("plain", [4, 3], 2)
    recordings.folder("patchy", [4, 3], 5, change=lambda i, a: a.pop("health") if i else None)
    recordings.folder("short", [4, 3], 5, total_frames=99)

    def served(*names, arrays=("dx", "health")):
        data = open_recordings(spark, recordings.root, manual=list(names))
        keep = data.sessions.where(data.sessions["session"].isin(list(names)))
        data.sessions, data.headers = keep, data.headers.join(keep.select("session"), "session", "left_semi")
        return data.frames(list(arrays))
    assert served("fine").count() == 7
    assert served("plain", arrays=["dx"]).count() == 7
    with pytest.raises(Exception, match="no radar array in session plain"):
        served("fine", "plain", arrays=["radar"]).collect()
    with pytest.raises(Exception, match="not aligned in session patchy: health"):
        served("fine", "patchy").collect()
    with pytest.raises(Exception, match="session short has 7 frames where its manifest has 99"):
        served("fine", "short").collect()
