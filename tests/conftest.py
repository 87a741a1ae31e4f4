"""Shared Spark session and generated recordings in the stored format."""

from __future__ import annotations

import json
import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from replaylens.fixed_values import KEY_NAMES  # noqa: E402
from replaylens.session import local_session, shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "4"), "4g")
    shared_folder(session)
    yield session
    session.stop()


def _every(i, period, shift=0):
    return ((i + shift) % period == 0).astype(np.uint8)


def _picture(i, height, width):
    """A moving pattern, different for every frame, place and channel."""
    y, x, c = np.ogrid[:height, :width, :3]
    plane = y * 7 + x * 13 + c * 101 + ((y * x) >> 3)
    return ((plane[None] + (i * 31)[:, None, None, None]) % 256).astype(np.uint8)


def _held(i):
    """Key k is held in every third stretch of k + 1 frames."""
    return np.stack([((i // (k + 1)) % 3 == 0) for k in range(len(KEY_NAMES))], axis=1).astype(np.uint8)


def _clock(i):
    """Fifteen frames a second, and half a second's pause after every eighth frame."""
    return i / 15 + (i // 8) * 0.5


def _pick(i, texts, width):
    return np.array(texts)[i % len(texts)].astype(f"<U{width}")


# Each array of the stored format: the first version that has it, and its values by the number of the frame.
SCRIPT = {
    "frames": (1, lambda i: _picture(i, 150, 270)),
    "timestamps": (1, _clock),
    "keys": (1, _held),
    "lclick": (1, lambda i: _every(i, 4)),
    "rclick": (1, lambda i: _every(i, 5, 2)),
    "dx": (1, lambda i: (i * 17 % 101 - 50).astype(np.int32)),
    "dy": (1, lambda i: (i * 29 % 83 - 41).astype(np.int32)),
    "radar": (3, lambda i: _picture(i + 7, 128, 128)),
    "alive": (4, lambda i: 1 - _every(i, 6, 1)),
    "round_phase": (4, lambda i: _pick(i // 2, ["live", "live", "over", "freezetime", "?"], 16)),
    "health": (5, lambda i: (100 - i * 3 % 101).astype(np.uint8)),
    "active_weapon": (5, lambda i: _pick(i // 3, ["weapon_a", "weapon_b", ""], 24)),
    "ammo_clip": (5, lambda i: (30 - i % 32).astype(np.int16)),
    "ammo_reserve": (5, lambda i: (i * 5 % 91 - 1).astype(np.int16)),
}


class Recordings:
    """Writes scripted sessions into a folder and remembers their arrays."""

    def __init__(self, root):
        self.root = str(root)
        self.arrays: dict[str, list[dict]] = {}

    def save(self, path: str, first: int, n: int, version: int, change=None) -> dict:
        """One file with the frames from number ``first`` on."""
        i = np.arange(first, first + n)
        arrays = {name: values(i) for name, (since, values) in SCRIPT.items() if version >= since}
        arrays |= {"key_names": np.array(KEY_NAMES), "schema_version": np.array(version),
                   "geom": np.array("synthetic"), "loop_fps_target": np.array(15)}
        if change:
            change(arrays)
        np.savez_compressed(os.path.join(self.root, path), **arrays)
        return arrays

    def file(self, name: str, n: int, seed: int = 1) -> None:
        self.arrays[name] = [self.save(f"{name}.npz", seed * 1000, n, 1)]

    def folder(self, name: str, sizes, version: int, seed: int = 1, change=None, order=None, **manifest) -> None:
        """A session of chunks; ``change(i, arrays)`` edits chunk i, ``manifest`` its entries ("absent" leaves one out)."""
        os.makedirs(os.path.join(self.root, name))
        starts = np.cumsum([seed * 1000, *sizes])
        saved = {f"chunk_{i:05d}.npz": self.save(f"{name}/chunk_{i:05d}.npz", int(starts[i]), n, version,
                                                 change and (lambda arrays, i=i: change(i, arrays)))
                 for i, n in enumerate(sizes)}
        listed = [list(saved)[i] for i in (order if order is not None else range(len(sizes)))]
        self.arrays[name] = [saved[file] for file in listed]
        body = {"schema_version": version, "session": name, "geom": "synthetic", "loop_fps_target": 15,
                "chunks": listed, "total_frames": sum(sizes), "complete": True} | manifest
        with open(os.path.join(self.root, name, "manifest.json"), "w") as f:
            json.dump({k: x for k, x in body.items() if x != "absent"}, f)

    def joined(self, name: str, array: str) -> np.ndarray:
        return np.concatenate([c[array] for c in self.arrays[name]])


@pytest.fixture
def recordings(tmp_path):
    return Recordings(tmp_path)
