"""What stored sessions cost for each file: listings, members read without layers, packed pictures, batches."""

from __future__ import annotations

import io
import os
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from catalog import stored
from replaylens.plans.training import open_recordings
from replaylens.sources import chunks


def _archive(**arrays) -> bytes:
    held = io.BytesIO()
    np.savez_compressed(held, **arrays)
    return held.getvalue()


def test_members_are_read_without_zipfile_layers(monkeypatch):
    """Headers, metadata and rows of deflated members; a row range goes on where the last one ended."""
    frames = np.random.default_rng(1).integers(0, 255, (50, 30, 40, 3), dtype=np.uint8)
    data = _archive(frames=frames, keys=np.asfortranarray(np.arange(12).reshape(4, 3)), geom=np.array("made"), none=np.zeros((0, 2)))
    monkeypatch.setattr(zipfile.ZipFile, "open", None)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert chunks._length(z, "frames") == 50 and chunks._length(z, "geom") is None
        assert str(chunks._member(z, "geom")) == "made" and chunks._member(z, "none").shape == (0, 2)
        assert chunks._member(z, "keys").tolist() == np.arange(12).reshape(4, 3).tolist()
        rows, other = chunks.StreamedArray(z, "frames"), chunks.StreamedArray(z, "keys")
        assert (rows.read(20) == frames[:20]).all() and other.read(4)[3, 2] == 11
        rows.skip(7)
        assert (rows.read(23) == frames[27:]).all()


@pytest.mark.parametrize("kind", [zipfile.ZIP_STORED, zipfile.ZIP_BZIP2])
def test_other_members_are_read_too(kind):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", kind) as z, z.open("dx.npy", "w") as f:
        np.lib.format.write_array(f, np.arange(9))
    with zipfile.ZipFile(held) as z:
        assert chunks._length(z, "dx") == 9 and chunks._member(z, "dx").tolist() == list(range(9))


def test_damaged_members_are_refused():
    data = bytearray(stored._npz({"dx": stored._array(np.arange(100))}))
    data[data.index(b"NUMPY") + 300] ^= 1
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z, pytest.raises(zipfile.BadZipFile):
        chunks.StreamedArray(z, "dx").read(100)


def test_pictures_are_summed_once(monkeypatch):
    """The checksum of an array of pictures follows from those of the pictures; no byte is summed again."""
    values, hw = [1, 100, 1, 255] * 3, (15, 27)
    stored._pictures(values, hw)
    summed, real = [], stored.zlib.crc32
    monkeypatch.setattr(stored.zlib, "crc32", lambda data, *a: summed.append(len(data)) or real(data, *a))
    size, crc, parts = stored._pictures(values, hw)
    raw = io.BytesIO()
    np.lib.format.write_array(raw, np.array(values, np.uint8).reshape(-1, 1, 1, 1) * np.ones((1, *hw, 3), np.uint8))
    assert (size, crc) == (len(raw.getvalue()), real(raw.getvalue())) and sum(summed) < 15 * 27 * 3


def test_short_batches_are_gathered():
    short = [pa.RecordBatch.from_pydict({"x": list(range(i, i + 5))}) for i in range(0, 500, 5)]
    found = list(chunks.gathered(iter(short), 800))
    assert len(found) == 5 and [x for b in found for x in b.column("x").to_pylist()] == list(range(500))
    assert list(chunks.gathered(iter([]))) == []


def test_a_folder_is_listed_once(spark, recordings):
    """Every table of a dataset stands on the same list, whatever comes into the folder later."""
    recordings.folder("one", [3], 5)
    data = open_recordings(spark, recordings.root)
    recordings.folder("two", [3], 5, seed=2)
    os.rename(f"{recordings.root}/one/manifest.json", f"{recordings.root}/one/gone.json")
    assert [r["session"] for r in data.sessions.collect()] == ["one"] == [r["session"] for r in data.split.collect()]
    assert data.frames(["dx"]).count() == 3
