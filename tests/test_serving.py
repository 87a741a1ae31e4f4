"""Streamed chunk reading, masks inside the decoder, and batches served on request."""

import tracemalloc
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from replaylens.operators import validate
from replaylens.plans.training import open_recordings
from replaylens.sources import chunks, manifests, serving

MASK = "session STRING, frame_idx LONG, keep BOOLEAN, source_frames LONG"


def _chunk(path, n, **change):
    arrays = {"frames": np.zeros((n, 150, 270, 3), np.uint8), "timestamps": np.arange(n) / 15.0,
              "keys": np.zeros((n, 11), np.uint8), "lclick": np.zeros(n, np.uint8), "rclick": np.zeros(n, np.uint8),
              "dx": np.arange(n, dtype=np.int32), "dy": np.arange(n, dtype=np.int32)} | change
    np.savez_compressed(path, **arrays)
    return {"chunk_path": str(path), "chunk_version": 5, "lengths": {a: len(x) for a, x in arrays.items()}}


def test_decoding_holds_some_rows_only(tmp_path):
    n, row = 1200, 150 * 270 * 3
    chunk = _chunk(tmp_path / "big.npz", n)
    tracemalloc.start()
    seen = sum(len(at) for at, _ in chunks.decode(chunk, ["frames", "dx"], rows_per_batch=64))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    places = [at.tolist() for at, _ in chunks.decode(chunk, ["frames"], picks=np.array([5, 700, 1199]), rows_per_batch=64)]
    picked = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and places == [[5], [700], [1199]]
    assert held < 5 * 64 * row and picked < 5 * 64 * row < n * row / 3


def test_decoding_by_columns_and_cut_files(tmp_path):
    keys = np.asfortranarray(np.arange(77, dtype=np.uint8).reshape(7, 11))
    chunk = _chunk(tmp_path / "c.npz", 7, keys=keys)
    got = np.concatenate([d["keys"] for _, d in chunks.decode(chunk, ["keys"], rows_per_batch=3)])
    assert (got == keys).all()
    cut = tmp_path / "cut.npz"
    with zipfile.ZipFile(chunk["chunk_path"]) as a, zipfile.ZipFile(cut, "w") as b:
        for name in a.namelist():
            data = a.read(name)
            b.writestr(name, data[:-3] if name == "dx.npy" else data)
    with pytest.raises(ValueError, match="dx ends early"):
        list(chunks.decode(chunk | {"chunk_path": str(cut)}, ["dx"], rows_per_batch=3))
    _chunk(tmp_path / "o.npz", 2, dx=np.array([{}, {}], dtype=object))
    with pytest.raises(ValueError, match="Python objects"):
        list(chunks.decode(chunk | {"chunk_path": str(tmp_path / "o.npz"), "lengths": chunk["lengths"]}, ["dx"]))


def test_filters_inside_the_decoder(tmp_path):
    n = 40
    alive, phase = np.arange(n) % 4 > 0, np.where(np.arange(n) % 5 == 1, "freezetime", "live")
    chunk = _chunk(tmp_path / "f.npz", n, alive=alive.astype(np.uint8), round_phase=phase)
    bits = np.zeros(4096 * 8, np.uint8)
    bits[[3, 39]] = 1
    chunk["dropped"] = [np.packbits(bits, bitorder="little").tobytes()]
    for size in (1, 7, 256):
        got = np.concatenate([at for at, _ in chunks.decode(chunk, ["alive", "dx"], True, rows_per_batch=size)])
        assert got.tolist() == [i for i in range(n) if i % 4 and i % 5 != 1 and i not in (3, 39)]
        assert all((d["dx"] == at).all() for at, d in chunks.decode(chunk, ["dx"], True, rows_per_batch=size))
    assert list(chunks.decode(chunk, ["dx"], picks=np.array([], dtype=int))) == []


@pytest.fixture
def stored(spark, recordings):
    recordings.folder("s5", [30, 1, 9], 5, order=[0, 2, 1])
    recordings.folder("s3", [6, 5], 3, seed=2)
    recordings.file("old", 8, seed=3)
    return open_recordings(spark, recordings.root)


def _action(recordings, session, i):
    one = lambda a: recordings.joined(session, a)[i]
    return [*one("keys").tolist(), one("lclick"), one("rclick"), one("dx"), one("dy")]


@pytest.mark.parametrize("in_order", [False, True])
def test_batches_on_request(spark, recordings, stored, in_order):
    asked = [("old", 5), ("s5", 0), ("s5", 39), ("s3", 10), ("s5", 12), ("old", 0), ("s5", 12), ("s3", 5), ("s5", 30)] * 3
    request = spark.createDataFrame([(10 * i, *a) for i, a in enumerate(asked)], "pos LONG, session STRING, frame_idx LONG")
    rows = stored.serve(request, "centre", in_order).collect()
    if in_order:
        assert [r["pos"] for r in rows] == [10 * i for i in range(len(asked))]
    rows = sorted(rows, key=lambda r: r["pos"])
    assert [(r["session"], r["frame_idx"]) for r in rows] == asked
    for r in rows:
        image = recordings.joined(r["session"], "frames")[r["frame_idx"], 27:123, 55:215]
        assert bytes(r["image"]) == image.tobytes()
        assert list(r["action"]) == _action(recordings, r["session"], r["frame_idx"])
    served = stored.serve(request, (0, 0, 2, 3), in_order)
    assert validate.not_served_once(request, served, ["pos", "session", "frame_idx"]).count() == 0
    assert stored.serve(request.limit(0), "full", in_order).count() == 0


def test_many_requests_for_one_chunk(spark, recordings, stored):
    request = spark.range(500).select(F.col("id").alias("pos"), F.lit("s5").alias("session"), (F.col("id") % 3).alias("frame_idx"))
    placed = stored.checked_chunks()
    rows = serving.serve_by_chunk(request, placed, None, ["dx"], asked_at_once=20).collect()
    dx = recordings.joined("s5", "dx")
    assert sorted((r["pos"], r["dx"]) for r in rows) == [(i, dx[i % 3]) for i in range(500)]
    rows = serving.serve_in_order(request, placed, None, ["dx", "health"], tasks=3, batch_rows=7).collect()
    assert [(r["pos"], r["dx"]) for r in rows] == [(i, dx[i % 3]) for i in range(500)]


@pytest.mark.parametrize("in_order", [False, True])
def test_refused_requests(spark, recordings, stored, in_order):
    def ask(*rows, image="full"):
        request = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos LONG, session STRING, frame_idx LONG")
        return stored.serve(request, image, in_order)
    with pytest.raises(Exception, match="requested frame 40 of session s5 does not exist"):
        ask(("s5", 0), ("s5", 40)).collect()
    with pytest.raises(Exception, match="requested frame -1 of session s3 does not exist"):
        ask(("s3", -1)).collect()
    with pytest.raises(Exception, match="of session nobody does not exist"):
        ask(("nobody", 0), ("s3", 1)).collect()
    recordings.folder("s2", [3], 2, seed=4)
    stored = open_recordings(spark, recordings.root)
    with pytest.raises(ValueError, match=r"2 session\(s\) have no radar array: \['old', 's2'\]"):
        ask(("s5", 0), ("old", 0), ("s2", 1), image="radar")  # before any action
    radar = recordings.joined("s3", "radar")
    got = ask(("s3", 9), ("s3", 2), image="radar").orderBy("pos").collect()
    assert [bytes(r["image"]) for r in got] == [radar[9].tobytes(), radar[2].tobytes()]


def test_masks_in_the_scan(spark, recordings, stored):
    keep = lambda i: i % 3 != 1
    rows = [("s5", i, keep(i), 40) for i in range(40)] + [("s3", i, False, 12) for i in range(12)] + [("old", 2, None, 8)]
    mask = spark.createDataFrame(rows, MASK)
    got = {(r["session"], r["frame_idx"], r["dx"]) for r in stored.frames(["dx"], mask=mask).collect()}
    want = {(s, i, int(x)) for s in ("s5", "s3", "old") for i, x in enumerate(recordings.joined(s, "dx"))
            if s != "s5" or keep(i)}
    assert got == want
    alive, phase = recordings.joined("s5", "alive"), recordings.joined("s5", "round_phase")
    both = stored.frames(["dx", "alive"], mask=mask, gameplay_filter=True)
    assert {r["frame_idx"] for r in both.where("session = 's5'").collect()} == {
        i for i in range(40) if keep(i) and alive[i] and phase[i] != "freezetime"}
    assert both.where("session <> 's5'").count() == 19
    assert stored.frames(["dx"], mask=mask.limit(0)).count() == 59


def test_a_chunk_longer_than_a_bitmap(spark):
    placed = spark.createDataFrame([("s", 0, 10, {"frames": 70_000}, 70_010), ("s", 1, 70_010, {"frames": 0}, 70_010)],
                                   "session STRING, chunk_idx INT, frame_base LONG, lengths MAP<STRING, LONG>, n_frames LONG")
    gone = [10, 32_777, 32_778, 70_009]
    mask = spark.createDataFrame([("s", i, False, 70_010) for i in gone] + [("s", 11, True, 70_010)], MASK)
    row = serving.mask_slices(mask, placed).where("chunk_idx = 0").first()
    bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little") for b in row["dropped"]])
    assert (np.flatnonzero(bits) + 10).tolist() == gone and len(row["dropped"]) == 3


def test_oddly_typed_manifest_fields(spark, recordings):
    """A field of another kind is not known; the session is usable as far as the rest says."""
    recordings.folder("odd", [3, 2], 3, loop_fps_target="fast", geom={"w": 1}, schema_version="three")
    recordings.folder("count", [3], 3, seed=2, total_frames="many")
    recordings.folder("text", [3], 3, seed=3, chunks="chunk_00000.npz")
    for name, text in (("list", "[1, 2]"), ("cut", '{"complete": tr')):
        recordings.folder(name, [1], 2, seed=4)
        with open(f"{recordings.root}/{name}/manifest.json", "w") as f:
            f.write(text)
    rows = {r["session"]: r for r in manifests.scan_sessions(spark, recordings.root).collect()}
    assert {s: r["reason"] for s, r in rows.items()} == {
        "odd": None, "count": None, "text": manifests.EMPTY, "list": manifests.UNREADABLE, "cut": manifests.UNREADABLE}
    assert rows["odd"]["loop_fps_target"] is None and rows["odd"]["total_frames"] == 5
    assert rows["count"]["total_frames"] is None and rows["count"]["schema_version"] == 3
    assert open_recordings(spark, recordings.root).frames(["dx"]).groupBy("session").count().count() == 2


def test_chunk_headers_are_read_once(spark, stored):
    before = stored.stored_headers()
    assert stored.frames(["dx"]).count() == 59 and stored.stored_headers() is before
    stored.headers = stored.headers.where("session = 's3'")
    assert stored.frames(["dx"]).count() == 11
