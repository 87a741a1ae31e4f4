"""Chunk files (npz) as rows.

The chunk list is a DataFrame, so sessions are pruned by ordinary filters and
joins before any file is opened, and each file is opened by the task that needs
it. An npz keeps each array as its own zip member: arrays that are not asked for
are not read, and headers alone give every length. Members are decompressed as
streams, so a task holds some rows of a chunk and never the whole of it, and rows
that a mask, a filter or a request leaves out are dropped before they become rows.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import FREEZETIME, MANDATORY_ARRAYS, OPTIONAL_ARRAYS, SUPPORTED_VERSIONS
from ..functions.pixels import as_binary, cut, resolve_input
from ..operators.ordered import even_positions

# Column type of each array; images stay raw bytes, row-major height x width x 3.
ARRAY_TYPES = {
    "frames": "BINARY", "radar": "BINARY", "timestamps": "DOUBLE", "keys": "ARRAY<TINYINT>",
    "lclick": "TINYINT", "rclick": "TINYINT", "dx": "INT", "dy": "INT", "alive": "TINYINT",
    "round_phase": "STRING", "health": "SMALLINT", "active_weapon": "STRING",
    "ammo_clip": "SMALLINT", "ammo_reserve": "SMALLINT",
}
SCALAR_ARRAYS = [a for a in ARRAY_TYPES if a not in ("frames", "radar")]
_ARROW = {"DOUBLE": pa.float64(), "TINYINT": pa.int8(), "INT": pa.int32(), "SMALLINT": pa.int16(),
          "STRING": pa.string(), "BINARY": pa.binary(), "ARRAY<TINYINT>": pa.list_(pa.int8())}
ROWS_PER_BATCH = 256
BYTES_AT_ONCE = 2 << 20


def _open(uri: str) -> zipfile.ZipFile:
    """Open a chunk on any file system Arrow knows; only read members are fetched."""
    if "://" not in uri and not uri.startswith("file:"):
        return zipfile.ZipFile(uri)
    from urllib.parse import unquote, urlparse
    parsed = urlparse(uri)
    if parsed.scheme == "file":
        return zipfile.ZipFile(unquote(parsed.path))
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return zipfile.ZipFile(fs.open_input_file(path))


class _Inflated:
    """The bytes of a deflated member in order, inflated into the size asked for; its checksum is tested behind the last."""

    def __init__(self, archive: zipfile.ZipFile, info: zipfile.ZipInfo):
        self._file, self._info, self._at = archive.fp, info, _first_byte(archive, info)
        self._packed, self._left, self._crc, self._tail = info.compress_size, info.file_size, 0, b""
        self._inflate = zlib.decompressobj(-15)

    def read(self, size: int) -> bytes:
        parts, size = [], min(size, self._left)
        while size > 0:
            if not self._tail and self._packed:
                self._file.seek(self._at)
                self._tail = self._file.read(min(self._packed, 1 << 16))
                self._at, self._packed = self._at + len(self._tail), self._packed - len(self._tail)
            before = len(self._tail)
            part = self._inflate.decompress(self._tail, size)
            self._tail = self._inflate.unconsumed_tail
            if not part and len(self._tail) == before:
                break  # the file ends early
            self._crc, size, self._left = zlib.crc32(part, self._crc), size - len(part), self._left - len(part)
            parts.append(part)
            if not self._left and self._crc != self._info.CRC:
                raise zipfile.BadZipFile(f"Bad CRC-32 for file {self._info.filename!r}")
        return parts[0] if len(parts) == 1 else b"".join(parts)


def _first_byte(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> int:
    """Where a member's data begin, behind its local header."""
    archive.fp.seek(info.header_offset)
    local = archive.fp.read(30)
    return info.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")


def _opened(archive: zipfile.ZipFile, name: str):
    """A member to be read in order. Members are many and short, so the usual kind goes without zipfile's layers."""
    info = archive.getinfo(f"{name}.npy")
    if info.compress_type == zipfile.ZIP_DEFLATED and not info.flag_bits & 1:
        return _Inflated(archive, info)
    return archive.open(info)


def _member(archive: zipfile.ZipFile, name: str) -> np.ndarray:
    f = _opened(archive, name)
    shape, by_column, dtype = _header(f)
    if dtype.hasobject:
        raise ValueError(f"array {name} holds Python objects")
    n = int(np.prod(shape, dtype=np.int64))
    return np.frombuffer(f.read(n * dtype.itemsize), dtype, n).reshape(shape, order="F" if by_column else "C")


@lru_cache(maxsize=4096)
def _parsed(header: bytes) -> tuple[tuple, bool, np.dtype]:
    """Shape, whether stored column by column, and type. Chunks of the same length share their headers."""
    held = io.BytesIO(header)
    read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(held) == (1, 0) else np.lib.format.read_array_header_2_0
    return read(held)


def _header(f) -> tuple[tuple, bool, np.dtype]:
    """The header of an array; the file is left at its first row."""
    start = f.read(8)
    size = f.read(2 if start[6:7] == b"\x01" else 4)
    return _parsed(start + size + f.read(int.from_bytes(size, "little")))


class StreamedArray:
    """An array of a chunk, read some rows at a time.

    Only the rows asked for are held. An array of several dimensions stored column by
    column has no rows to stream, so that one is read whole.
    """

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self._file, self.name, self.at = _opened(archive, name), name, 0
        self.shape, by_column, self.dtype = _header(self._file)
        if self.dtype.hasobject:
            raise ValueError(f"array {name} holds Python objects")
        self._row = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))
        self._whole = None
        if by_column and len(self.shape) > 1:
            data = np.frombuffer(self._file.read(self._row * self.shape[0]), dtype=self.dtype)
            self._whole = np.ascontiguousarray(data.reshape(self.shape, order="F"))

    def read(self, rows: int) -> np.ndarray:
        """The next ``rows`` rows."""
        self.at += rows
        if self._whole is not None:
            return self._whole[self.at - rows:self.at]
        data = self._file.read(rows * self._row)
        if len(data) < rows * self._row:
            raise ValueError(f"array {self.name} ends early")
        return np.frombuffer(data, dtype=self.dtype).reshape(rows, *self.shape[1:])

    def skip(self, rows: int) -> None:
        """Pass over rows: they are decompressed but not kept."""
        self.at += rows
        left = rows * self._row if self._whole is None else 0
        while left:
            got = len(self._file.read(min(left, 1 << 20)))
            if not got:
                raise ValueError(f"array {self.name} ends early")
            left -= got


def _length(archive: zipfile.ZipFile, name: str) -> int | None:
    """Rows of an array, from its header only."""
    shape = _header(_opened(archive, name))[0]
    return shape[0] if shape else None


def spread(chunks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distribute chunk rows over tasks. The rows are tiny but their files are not, so
    the number is set here rather than left to size-based coalescing."""
    if tasks is None:
        tasks = 4 * chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.repartition(tasks, "chunk_path")


def read_headers(chunks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Array lengths and metadata of each chunk, without reading any per-frame data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with _open(row["chunk_path"]) as z:
                    have = {n.removesuffix(".npy") for n in z.namelist()}
                    def scalar(name, cast):
                        return cast(_member(z, name)) if name in have else None
                    row["lengths"] = [(a, _length(z, a)) for a in MANDATORY_ARRAYS + OPTIONAL_ARRAYS if a in have]
                    row["chunk_version"] = scalar("schema_version", int)
                    row["chunk_geom"] = scalar("geom", str)
                    row["chunk_fps"] = scalar("loop_fps_target", int)
                    row["chunk_key_names"] = scalar(
                        "key_names", lambda a: [k.decode() if isinstance(k, bytes) else str(k) for k in a])
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_HEADER_ARROW)
    return spread(chunks.select("session", "chunk_idx", "chunk_path"), tasks).mapInArrow(run, _HEADER_SCHEMA)


_HEADER_SCHEMA = ("session STRING, chunk_idx INT, chunk_path STRING, lengths MAP<STRING, BIGINT>, "
                  "chunk_version INT, chunk_geom STRING, chunk_fps INT, chunk_key_names ARRAY<STRING>")
_HEADER_ARROW = pa.schema([
    ("session", pa.string()), ("chunk_idx", pa.int32()), ("chunk_path", pa.string()),
    ("lengths", pa.map_(pa.string(), pa.int64())), ("chunk_version", pa.int32()),
    ("chunk_geom", pa.string()), ("chunk_fps", pa.int32()), ("chunk_key_names", pa.list_(pa.string()))])


def session_metadata(headers: DataFrame) -> DataFrame:
    """Per session: metadata from the first chunk that has it."""
    def first(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chunk_idx")))
    return headers.groupBy("session").agg(
        first("chunk_key_names").alias("key_names"), first("chunk_version").alias("file_version"),
        first("chunk_geom").alias("file_geom"), first("chunk_fps").alias("file_fps"))


def place_chunks(headers: DataFrame) -> DataFrame:
    """Give each chunk the session index of its first frame, in manifest order.

    One row per chunk, so the running sum is over a small table and frames get
    their index inside the decoding task, with no join or sort of frames.
    """
    order = Window.partitionBy("session").orderBy("chunk_idx")
    n = F.col("lengths")["frames"]
    return headers.withColumn("frame_base", F.coalesce(
        F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "n_frames", F.sum(n).over(Window.partitionBy("session")))


def chunks_to_sample(placed: DataFrame, k: int) -> DataFrame:
    """Chunks that hold at least one of the k evenly spaced frames of their session."""
    first = F.col("frame_base")
    last = first + F.col("lengths")["frames"] - 1
    return placed.where(F.exists(even_positions(F.col("n_frames"), k), lambda p: p.between(first, last)))


def _check(row: dict) -> int:
    """Rows of a chunk; one that can't be served whole is refused."""
    lengths, where = dict(row["lengths"]), row["chunk_path"]
    if row["chunk_version"] is not None and row["chunk_version"] not in SUPPORTED_VERSIONS:
        raise ValueError(f"{where}: schema_version={row['chunk_version']} is not supported")
    missing = set(MANDATORY_ARRAYS) - set(lengths)
    if missing:
        raise ValueError(f"{where}: arrays {sorted(missing)} are missing")
    if len(set(lengths.values())) > 1:
        raise ValueError(f"{where}: arrays differ in length: {lengths}")
    return lengths["frames"]


def _in_play(blocks: dict[str, np.ndarray], rows: int) -> np.ndarray:
    """Alive and not in freezetime, as far as the recording says so."""
    served = np.ones(rows, dtype=bool)
    if "alive" in blocks:
        served &= blocks["alive"] > 0
    if "round_phase" in blocks:
        served &= blocks["round_phase"].astype(str) != FREEZETIME
    return served


def decode(row: dict, wanted: list[str], gameplay_filter: bool = False, picks: np.ndarray | None = None,
           rows_per_batch: int = ROWS_PER_BATCH) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(places in the chunk, arrays) of the rows to serve, at most ``rows_per_batch`` at a time.

    ``row`` is a placed chunk. Its ``dropped`` bitmaps, if any, leave rows out, and so do
    the gameplay filter and ``picks`` (sorted places; null serves all). Blocks without a
    row to serve are passed over, and nothing behind the last pick is read.
    """
    n = _check(row)
    have = [a for a in wanted if a in row["lengths"]]
    sieve = [a for a in ("alive", "round_phase") if gameplay_filter and a in row["lengths"]]
    dropped = None
    if row.get("dropped"):
        dropped = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little") for b in row["dropped"]])
        dropped = np.pad(dropped, (0, max(0, n - len(dropped))))[:n].astype(bool)
    if picks is not None:
        if len(picks) and (picks[0] < 0 or picks[-1] >= n):
            raise ValueError(f"{row['chunk_path']}: frame {picks[0]} or {picks[-1]} asked of {n}")
        n = int(picks[-1]) + 1 if len(picks) else 0
    with _open(row["chunk_path"]) as z:
        arrays = {a: StreamedArray(z, a) for a in {*have, *sieve}}
        for lo in range(0, n, rows_per_batch):
            size = min(rows_per_batch, n - lo)
            blocks = {a: arrays[a].read(size) for a in sieve}
            served = _in_play(blocks, size)
            if dropped is not None:
                served &= ~dropped[lo:lo + size]
            if picks is not None:
                asked = np.zeros(size, dtype=bool)
                asked[picks[np.searchsorted(picks, lo):np.searchsorted(picks, lo + size)] - lo] = True
                served &= asked
            at = np.flatnonzero(served)
            for a in have:
                if a in blocks:
                    continue
                if len(at):
                    blocks[a] = arrays[a].read(size)
                else:
                    arrays[a].skip(size)
            if len(at):
                yield lo + at, {a: blocks[a] if len(at) == size else blocks[a][at] for a in have}


def as_column(name: str, data: np.ndarray | None, rows: int) -> pa.Array:
    """Rows of an array as an Arrow column of its type; an absent array is null."""
    kind = _ARROW[ARRAY_TYPES[name]]
    if data is None:
        return pa.nulls(rows, kind)
    if kind == pa.binary():
        return as_binary(data)
    if name == "keys":
        part = np.ascontiguousarray(data.astype(np.int8))
        at = pa.array(np.arange(rows + 1, dtype=np.int32) * part.shape[1])
        return pa.ListArray.from_arrays(at, pa.array(part.ravel()))
    if kind == pa.string():
        return pa.array(data.astype(str).tolist(), kind)
    return pa.array(data).cast(kind)


def gathered(batches: Iterator[pa.RecordBatch], size: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes where they came in smaller ones: each batch costs Spark a fixed share."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def known_arrays(arrays: list[str] | None) -> list[str]:
    wanted = list(arrays if arrays is not None else SCALAR_ARRAYS)
    unknown = [a for a in wanted if a not in ARRAY_TYPES]
    if unknown:
        raise ValueError(f"unknown arrays {unknown}; known are {list(ARRAY_TYPES)}")
    return wanted


def read_frames(placed: DataFrame, arrays: list[str] | None = None, tasks: int | None = None,
                keep: list[str] = (), gameplay_filter: bool = False, crop=None) -> DataFrame:
    """Rows of the placed chunks with the wanted arrays; absent optional arrays are null.

    ``keep`` names columns of the chunk table, such as side and key names, that every
    frame of the chunk should carry: joined there, they never shuffle an image. Frames
    that the chunk table's ``dropped`` bitmaps name (see ``serving.mask_slices``) or the
    gameplay filter rejects are left out inside the decoder.

    ``crop`` (see ``resolve_input``) cuts full frames inside the decoder, so that only the cut leaves it.

    A chunk whose arrays differ in length is refused, as is an unknown version.
    """
    wanted, keep = known_arrays(arrays), list(keep)
    image, rect = resolve_input(crop)
    if rect is not None and image not in wanted:
        raise ValueError(f"a crop needs the array {image}")
    names = ["session", "chunk_idx", "frame_idx"] + keep + wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_types = [batch.schema.field(c).type for c in keep]
            for row in batch.to_pylist():
                row["lengths"] = dict(row["lengths"])
                for at, data in decode(row, wanted, gameplay_filter):
                    n = len(at)
                    if rect is not None:
                        data[image] = cut(data[image], rect)
                    columns = [pa.array([row["session"]] * n), pa.array(np.full(n, row["chunk_idx"], np.int32)),
                               pa.array(at + row["frame_base"], type=pa.int64())]
                    columns += [pa.array([row[c]] * n, kind) for c, kind in zip(keep, kept_types)]
                    columns += [as_column(a, data.get(a), n) for a in wanted]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "session STRING, chunk_idx INT, frame_idx BIGINT" + "".join(
        [f", {c} {placed.schema[c].dataType.simpleString()}" for c in keep]
        + [f", {a} {ARRAY_TYPES[a]}" for a in wanted])
    masks = ["dropped"] if "dropped" in placed.columns else []
    source = placed.select("session", "chunk_idx", "chunk_path", "lengths", "chunk_version", "frame_base",
                           *masks, *[c for c in keep if c not in masks])
    frames = spread(source, tasks).mapInArrow(lambda batches: gathered(run(batches)), schema)
    return frames.withColumnRenamed("timestamps", "t") if "timestamps" in wanted else frames
