"""Registered queries on stored sessions: the events written as chunk files by executor tasks and read back."""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import xor
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from replaylens.fixed_values import CENTRE_CROP, FRAME_HW, RADAR_HW
from replaylens.operators import split, validate
from replaylens.operators.validate import counted_frames
from replaylens.plans.training import open_recordings
from replaylens.session import shared_folder, written
from replaylens.sources.chunks import SCALAR_ARRAYS, read_headers
from replaylens.sources.manifests import listed_chunks, scan_sessions, usable_sessions

from . import views as v
from .queries import query, text

# Version by session: every third has no state, every third no minimap either; every tenth was never finished.
_STORED = "user_id % 10 <> 0"
_VERSION = "case user_id % 3 when 0 then 2 when 1 then 3 else 5 end"
# Some of those without minimaps are bare files of the first version, which are always finished.
_BARE = "user_id % 6 = 3"
_FIRST = {"radar": 3, "alive": 4, "round_phase": 4, "health": 5, "active_weapon": 5, "ammo_clip": 5, "ammo_reserve": 5}
_KIND = {"timestamps": "f8", "keys": "u1", "lclick": "u1", "rclick": "u1", "dx": "i4", "dy": "i4", "alive": "u1",
         "round_phase": "U16", "health": "u1", "active_weapon": "U24", "ammo_clip": "i2", "ammo_reserve": "i2"}


def _put(uri: str, data: bytes) -> None:
    if urlparse(uri).scheme in ("", "file"):
        files, path = pyarrow.fs.LocalFileSystem(), unquote(urlparse(uri).path)
    else:
        files, path = pyarrow.fs.FileSystem.from_uri(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(data)


def _deflate(data: bytes, end: int = zlib.Z_FINISH) -> bytes:
    packer = zlib.compressobj(wbits=-15)
    return packer.compress(data) + packer.flush(end)


def _packed(data: bytes) -> bytes:
    """Deflated; a few KB as one stored block, since setting up a packer costs more than they hold."""
    if len(data) > 4096:
        return _deflate(data)
    return b"\1" + struct.pack("<HH", len(data), len(data) ^ 0xFFFF) + data


@lru_cache(maxsize=4096)
def _head(kind: str, shape: tuple[int, ...]) -> bytes:
    """The header of an array; chunks of the same length share theirs."""
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": kind, "fortran_order": False, "shape": shape})
    return head.getvalue()


@lru_cache(maxsize=8)
def _checksum_shift(n: int) -> list[list[int]]:
    """For each byte of a checksum, what it turns into once n more bytes follow: a checksum is linear in its bits."""
    zeros = bytes(n)
    bits = [zlib.crc32(zeros, 1 << i) ^ zlib.crc32(zeros) for i in range(32)]
    return [[reduce(xor, (bits[8 * j + i] for i in range(8) if value >> i & 1), 0) for value in range(256)] for j in range(4)]


@lru_cache(maxsize=512)
def _picture(value: int, hw: tuple[int, int]) -> tuple[int, bytes]:
    """Checksum of a picture of one value, and the picture deflated up to a byte boundary, so that others can follow."""
    raw = bytes([value]) * (hw[0] * hw[1] * 3)
    return zlib.crc32(raw), _deflate(raw, zlib.Z_FULL_FLUSH)


def _pictures(values: list[int], hw: tuple[int, int]) -> tuple[int, int, list[bytes]]:
    """Size, checksum and deflated parts of an array of pictures; a worker deflates and sums each picture once."""
    head, n = _head("|u1", (len(values), *hw, 3)), hw[0] * hw[1] * 3
    t0, t1, t2, t3 = _checksum_shift(n)
    crc, parts = zlib.crc32(head), [_deflate(head, zlib.Z_FULL_FLUSH)]
    for value in values:
        own, packed = _picture(value, hw)
        crc = t0[crc & 255] ^ t1[crc >> 8 & 255] ^ t2[crc >> 16 & 255] ^ t3[crc >> 24] ^ own
        parts.append(packed)
    return len(head) + n * len(values), crc, parts + [_deflate(b"")]


def _array(data: np.ndarray) -> tuple[int, int, list[bytes]]:
    raw = _head(data.dtype.str, data.shape) + data.tobytes()
    return len(raw), zlib.crc32(raw), [_packed(raw)]


@lru_cache(maxsize=64)
def _metadata(version: int, key_names: tuple[str, ...]) -> dict[str, tuple[int, int, list[bytes]]]:
    return {name: _array(np.array(value)) for name, value in (
        ("key_names", list(key_names)), ("geom", "generated"), ("schema_version", version), ("loop_fps_target", 15))}


def _npz(members: dict[str, tuple[int, int, list[bytes]]]) -> bytes:
    """A zip of arrays that are deflated already. Sizes are 64-bit, since a long bare file holds more than 4 GB of pictures."""
    out, listing, full = io.BytesIO(), [], 0xFFFFFFFF
    for name, (size, crc, parts) in members.items():
        at, packed, file = out.tell(), sum(map(len, parts)), f"{name}.npy".encode()
        common = struct.pack("<HHHHHLLLH", 45, 0, zipfile.ZIP_DEFLATED, 0, 33, crc, full, full, len(file))
        out.write(b"PK\3\4" + common + struct.pack("<H", 20) + file + struct.pack("<HHQQ", 1, 16, size, packed))
        out.writelines(parts)
        listing.append(b"PK\1\2" + struct.pack("<H", 45) + common + struct.pack("<HHHHLL", 28, 0, 0, 0, 0, full) + file
                       + struct.pack("<HHQQQ", 1, 24, size, packed, at))
    start, entries = out.tell(), b"".join(listing)
    out.write(entries + b"PK\5\6" + struct.pack("<HHHHLLH", 0, 0, len(listing), len(listing), len(entries), start, 0))
    return out.getvalue()


def _values(lists: pa.ListArray, kind: str) -> np.ndarray:
    """The values of all lists, one after another; values that are lists themselves become rows."""
    flat = lists.flatten()
    if pa.types.is_list(flat.type):
        return flat.flatten().to_numpy().astype(kind).reshape(len(flat), -1)
    return np.array(flat.to_pylist(), dtype=kind) if kind[0] == "U" else flat.to_numpy().astype(kind)


def _write_chunks(root: str):
    """A file for each row, which holds the frames of a chunk; written whole, so a retried task writes the same file again."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {name: _values(batch.column(name), kind) for name, kind in _KIND.items()}
            shades = (_values(batch.column("k"), "i8") + 1).tolist()
            ends = np.cumsum(batch.column("k").value_lengths().to_numpy()).tolist()
            rows = batch.select(["session", "version", "chunk_idx", "key_names"]).to_pylist()
            for row, lo, hi in zip(rows, [0, *ends], ends):
                has = lambda name: _FIRST.get(name, 1) <= row["version"]  # noqa: B023, E731
                members = {name: _array(values[name][lo:hi]) for name in _KIND if has(name)}
                members |= {name: _pictures(shades[lo:hi], hw) for name, hw in (("frames", FRAME_HW), ("radar", RADAR_HW)) if has(name)}
                members |= _metadata(row["version"], tuple(row["key_names"]))
                row["file"] = f"chunk_{row['chunk_idx']:05d}.npz"
                place = f"{root}/{row['session']}.npz" if row["version"] == 1 else f"{root}/{row['session']}/{row['file']}"
                _put(place, _npz(members))
            yield pa.RecordBatch.from_arrays(
                [batch.column("session"), batch.column("user_id"), batch.column("version"), pa.array([r["file"] for r in rows]),
                 batch.column("k").value_lengths().cast(pa.int64())], names=["session", "user_id", "version", "file", "n"])
    return write


def _write_manifests(root: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch[batch["version"] > 1].to_dict("records"):
                _put(f"{root}/{row['session']}/manifest.json", json.dumps({
                    "schema_version": row["version"], "session": row["session"], "geom": "generated",
                    "loop_fps_target": 15, "chunks": list(row["files"]), "total_frames": row["n"],
                    "complete": bool(row["user_id"] % 10)}).encode())
            yield batch[["session"]]
    return write


_WRITTEN: dict[tuple, str] = {}


def stored_sessions(spark: SparkSession, d: str, bare: bool = False) -> str:
    """All events as session folders in the shared folder, some as bare files if asked for; the folder's name.

    Several queries read the same files, so they are written once for each application.
    """
    key = (spark.sparkContext.applicationId, shared_folder(spark), d, bare)
    if key not in _WRITTEN:
        _WRITTEN[key] = _write_sessions(spark, d, bare)
    return _WRITTEN[key]


def _write_sessions(spark: SparkSession, d: str, bare: bool) -> str:
    root = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    version, chunk = (f"case when {_BARE} then {a} else {b} end" if bare else b
                      for a, b in (("1", _VERSION), ("0", "chunk_idx")))
    frames = v.frames(spark, d).selectExpr(
        "session", "user_id", f"{version} as version", f"{chunk} as chunk_idx", "frame_idx", "t as timestamps", "k",
        "key_names", *[a for a in _KIND if a != "timestamps"])
    columns = ["k", *_KIND]
    # A chunk's rows are few, its file is not: tasks are set here rather than left to size-based coalescing.
    dealt = frames.repartition(8 * spark.sparkContext.defaultParallelism, "session", "chunk_idx")
    chunks = dealt.groupBy("session", "user_id", "version", "chunk_idx", "key_names").agg(
        F.sort_array(F.collect_list(F.struct("frame_idx", *columns))).alias("rows"))
    files = chunks.select("session", "user_id", "version", "chunk_idx", "key_names", *[f"rows.{c}" for c in columns]).mapInArrow(
        _write_chunks(root), "session string, user_id long, version int, file string, n long")
    sessions = files.groupBy("session", "user_id", "version").agg(
        F.sort_array(F.collect_list("file")).alias("files"), F.sum("n").alias("n"))
    # A row stands for a file, so rows are dealt by number and not by size.
    sessions = sessions.repartition(4 * spark.sparkContext.defaultParallelism, "session")
    sessions.mapInPandas(_write_manifests(root), "session string").write.format("noop").mode("overwrite").save()
    return root


def _since(version: int, column: str) -> str:
    return f"case when version >= {version} then {column} end as {column}"


_KEYS = " || ',' || ".join(f"k_{k}" for k in v.KEY_RULES)


@query(f"""select session, case when {_BARE} then 0 else chunk_idx end as chunk_idx, frame_idx, round(t, 3) as t, {_KEYS} as keys, lclick, rclick, dx, dy,
  {', '.join(_since(n, a) for a, n in _FIRST.items() if a != 'radar')}, n_frames, 15 as file_fps
  from (select *, {_VERSION} as version, count(*) over (partition by session) as n_frames from f) where {_STORED}""", v.FRAMES)
def npz_roundtrip(spark, d):
    """Folders of three versions and bare files together."""
    frames = open_recordings(spark, stored_sessions(spark, d, bare=True)).frames(SCALAR_ARRAYS)
    return frames.drop("key_names", "side").withColumns({"keys": text("keys"), "t": F.round("t", 3)})


@query(f"select distinct session from f where {_STORED} and user_id % 3 = 0", v.FRAMES)
def radar_gate(spark, d):
    data = open_recordings(spark, stored_sessions(spark, d))
    return validate.without_radar(data.sessions, data.stored_headers())


@query(f"""select session, n_frames, bucket, case when bucket < 200 then 'holdout' else 'train' end as side from (select session, n_frames,
  cast(cast(concat('0x', substr(md5(session), 1, 15)) as bigint) % 1000 as int) as bucket from (select session, count(*) as n_frames
  from f where {_STORED} group by 1))""", v.FRAMES)
def usable_then_split(spark, d):
    sessions = usable_sessions(scan_sessions(spark, stored_sessions(spark, d)))
    return split.split_sessions(sessions, hash_name="md5").select(
        "session", F.col("total_frames").alias("n_frames"), "bucket", "side")


@query(f"""select session, frame_idx, sha256(repeat(chr(k + 1), {CENTRE_CROP[2] * CENTRE_CROP[3] * 3})) as digest
  from f where {_STORED}""", v.FRAMES)
def crop_input(spark, d):
    frames = open_recordings(spark, stored_sessions(spark, d)).frames(["frames"], crop="centre")
    return frames.select("session", "frame_idx", F.sha2("frames", 256).alias("digest"))


@query(f"select session, count(*) as n_frames, count(distinct chunk_idx) as n_chunks, any_value({_VERSION}) as version from f group by 1",
       v.FRAMES)
def stored_headers(spark, d):
    """Frames and chunks that headers count in each stored session, finished or not."""
    headers = read_headers(listed_chunks(scan_sessions(spark, stored_sessions(spark, d))))
    return headers.groupBy("session").agg(F.sum(F.col("lengths")["frames"]).alias("n_frames"),
                                          F.count("*").alias("n_chunks"), F.min("chunk_version").alias("version"))


_ACTION = " || ',' || ".join([f"k_{k}" for k in v.KEY_RULES] + ["lclick", "rclick", "dx", "dy"])


@query(f"""select event_id * 2 + again as pos, session, frame_idx, {_ACTION} as action,
  sha256(repeat(chr(k + 1), {CENTRE_CROP[2] * CENTRE_CROP[3] * 3})) as digest, 0::bigint as n_not_served_once
  from f join (values (0), (1)) r(again) on again = 0 or k % 7 = 0 where {_STORED}""", v.FRAMES)
def serve_batch(spark, d):
    """Every stored frame as a batch entry, in the order of events, and some of them twice."""
    data = open_recordings(spark, stored_sessions(spark, d, bare=True))
    again = F.explode(F.when(F.col("k") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    request = v.frames(spark, d).where(_STORED).select(
        "session", "frame_idx", "event_id", again.alias("again")).select(
        (F.col("event_id") * 2 + F.col("again")).alias("pos"), "session", "frame_idx")
    served = written(data.serve(request, "centre").select(
        "pos", "session", "frame_idx", text(F.transform("action", lambda x: x.cast("int"))).alias("action"),
        F.sha2("image", 256).alias("digest")), "served")
    wrong = validate.not_served_once(request, served, ["pos", "session", "frame_idx"])
    return served.withColumn("n_not_served_once", wrong.agg(F.count(F.lit(1))).scalar())


@query(f"""select session, frame_idx, dx, n_frames from (select *, count(*) over (partition by session) as n_frames from f)
  where {_STORED} and not (user_id % 3 = 2 and (alive = 0 or round_phase = 'freezetime'))
  and not (user_id % 4 < 2 and k % 5 = 0)""", v.FRAMES)
def served_with_mask(spark, d):
    """Gameplay frames by masks of which some are stale and some absent, picked while decoding."""
    data = open_recordings(spark, stored_sessions(spark, d, bare=True))
    lengths = counted_frames(data.stored_headers())
    mask = v.frames(spark, d).where("user_id % 4 < 3").join(lengths, "session").select(
        "session", "frame_idx", F.expr("k % 5 <> 0").alias("keep"),
        (F.col("n_counted") + F.expr("case when user_id % 4 = 2 then 1 else 0 end")).alias("source_frames"))
    return data.frames(["dx"], mask=mask, gameplay_filter=True).select("session", "frame_idx", "dx", "n_frames")
