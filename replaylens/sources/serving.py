"""Frames served from chunk files for a mask or a list of requests, without shuffling an image.

Masks and requests are narrow tables by frame. They are brought to the chunk list, a row
for each chunk, and the decoder picks the rows there. Two ways lead from requests to rows:

* by chunk: each chunk is decoded once and its rows carry the position that asked for
  them. The right way for a whole epoch, in any order.
* in request order: each task takes a range of positions, and fills one batch after
  another from the chunks it needs. The right way for a stretch of frames or a few
  batches, since a chunk is decoded again for each batch that asks for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CHUNK_FRAMES
from ..functions.pixels import as_binary, resolve_input
from .chunks import ARRAY_TYPES, ROWS_PER_BATCH, as_column, decode, gathered, known_arrays, spread

ASKED_AT_ONCE = 4096  # requests of a chunk that one task answers in one pass over it


def on_chunks(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Add ``chunk_idx`` and ``local``, the frame's place in the chunk, to rows with (session, frame_idx).

    Both are null for a frame that does not exist. Chunks are cut at a fixed grid of frame
    indices, so the join has equal keys however long a session is.
    """
    last = F.col("frame_base") + F.col("lengths")["frames"] - 1
    cell = lambda c: F.floor(c / F.lit(CHUNK_FRAMES))
    spans = placed.where(F.col("lengths")["frames"] > 0).select(
        F.col("session").alias("_session"), F.col("chunk_idx"), F.col("frame_base").alias("_first"),
        last.alias("_last"), F.explode(F.sequence(cell(F.col("frame_base")), cell(last))).alias("_cell"))
    inside = (F.col("session") == F.col("_session")) & F.col("frame_idx").between(F.col("_first"), F.col("_last"))
    asked = rows.withColumn("_at", cell(F.col("frame_idx")))
    return asked.join(spans, inside & (F.col("_at") == F.col("_cell")), "left").select(
        *rows.columns, "chunk_idx", (F.col("frame_idx") - F.col("_first")).cast("int").alias("local"))


def mask_slices(mask: DataFrame, placed: DataFrame) -> DataFrame:
    """The placed chunks with ``dropped``: bitmaps of the frames that a current mask leaves out.

    A mask made for another number of frames is stale and drops nothing; nor do frames
    without a mask row, or a null ``keep``. A bitmap is 4 KB for 32 768 frames; a longer chunk has several.
    """
    fresh = placed.select("session", F.col("n_frames").alias("source_frames")).distinct()
    gone = mask.where(~F.col("keep")).join(fresh, ["session", "source_frames"], "left_semi").select(
        "session", "frame_idx")
    bit = F.col("local") + 1  # these functions count from one
    pieces = on_chunks(gone, placed).where("chunk_idx IS NOT NULL").groupBy(
        "session", "chunk_idx", F.bitmap_bucket_number(bit).alias("_nth")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    slices = pieces.groupBy("session", "chunk_idx").agg(F.map_from_entries(
        F.collect_list(F.struct("_nth", "_bits"))).alias("_bits"), F.max("_nth").alias("_n"))
    empty = F.lit(bytes(4096))
    bitmaps = F.transform(F.sequence(F.lit(1).cast("long"), "_n"), lambda i: F.coalesce(F.col("_bits")[i], empty))
    return placed.join(slices.select("session", "chunk_idx", bitmaps.alias("dropped")), ["session", "chunk_idx"], "left")


def _asked(request: DataFrame, placed: DataFrame) -> DataFrame:
    """Requests (pos, session, frame_idx) with their place; nulls where no chunk has the frame."""
    return on_chunks(request.select(F.col("pos").cast("long").alias("pos"), "session", "frame_idx"), placed)


def _refuse_missing(session: str, frame_idx, chunk_path: str | None) -> None:
    if chunk_path is None:
        raise ValueError(f"requested frame {frame_idx} of session {session} does not exist")


def _columns(image, arrays: list[str] | None) -> tuple[str | None, tuple | None, list[str], str]:
    """The image array and its crop, the other arrays, and the schema of what is served."""
    source, rect = resolve_input(image) if image is not None else (None, None)
    others = known_arrays(arrays)
    schema = "pos BIGINT, session STRING, frame_idx BIGINT" + (", image BINARY" if source else "") + "".join(
        f", {a} {ARRAY_TYPES[a]}" for a in others)
    return source, rect, others, schema


def _cropped(data: dict[str, np.ndarray], source: str | None, rect, where: str) -> np.ndarray | None:
    if source is None:
        return None
    if source not in data:
        raise ValueError(f"{where}: no array {source}")
    if rect is None:
        return data[source]
    top, left, height, width = rect
    return data[source][:, top:top + height, left:left + width]


def serve_by_chunk(request: DataFrame, placed: DataFrame, image="full", arrays: list[str] | None = None,
                   tasks: int | None = None, asked_at_once: int = ASKED_AT_ONCE) -> DataFrame:
    """(pos, session, frame_idx, image, arrays...) of every request, chunk by chunk.

    A chunk that is asked for more often than ``asked_at_once`` is dealt to several rows,
    by a hash of the position, so that no list of requests outgrows a task.
    """
    source, rect, others, schema = _columns(image, arrays)
    wanted = list(dict.fromkeys(([source] if source else []) + others))
    at = _asked(request, placed)
    key = ["session", "chunk_idx"]
    parts = at.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / asked_at_once).alias("_parts"))
    part = F.pmod(F.xxhash64("pos"), F.coalesce("_parts", F.lit(1)))
    lists = at.join(parts, key, "left").groupBy(*key, part.alias("_part")).agg(
        F.sort_array(F.collect_list(F.struct("local", "pos"))).alias("asked"), F.min("frame_idx").alias("_any"))
    listed = lists.join(placed.select(*key, "chunk_path", "lengths", "chunk_version", "frame_base"), key, "left").select(
        *key, "chunk_path", "lengths", "chunk_version", "frame_base", "_any",
        F.col("asked.local").alias("locals"), F.col("asked.pos").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _refuse_missing(row["session"], row["_any"], row["chunk_path"])
                row["lengths"] = dict(row["lengths"])
                places, positions = np.array(row["locals"]), np.array(row["positions"], dtype=np.int64)
                done = 0
                for found, data in decode(row, wanted, picks=np.unique(places)):
                    images = _cropped(data, source, rect, row["chunk_path"])
                    end = int(np.searchsorted(places, found[-1], "right"))
                    of = np.searchsorted(found, places[done:end])  # a frame asked for twice is served twice
                    for lo in range(0, len(of), ROWS_PER_BATCH):
                        take = of[lo:lo + ROWS_PER_BATCH]
                        yield _served(positions[done + lo:done + lo + len(take)], [row["session"]] * len(take),
                                      found[take] + row["frame_base"], None if images is None else images[take],
                                      {a: data[a][take] for a in others if a in data}, others)
                    done = end
                if done != len(places):
                    raise AssertionError(f"{row['chunk_path']}: {done} of {len(places)} requests were served")
    return spread(listed, tasks).mapInArrow(lambda batches: gathered(run(batches)), schema)


def _served(positions, sessions, frame_idx, images, data: dict, others: list[str]) -> pa.RecordBatch:
    n = len(positions)
    columns = [pa.array(positions, pa.int64()), pa.array(sessions, pa.string()), pa.array(frame_idx, pa.int64())]
    names = ["pos", "session", "frame_idx"]
    if images is not None:
        columns.append(as_binary(images))
        names.append("image")
    columns += [as_column(a, data.get(a), n) for a in others]
    return pa.RecordBatch.from_arrays(columns, names=names + others)


def serve_in_order(request: DataFrame, placed: DataFrame, image="full", arrays: list[str] | None = None,
                   tasks: int | None = None, batch_rows: int = ROWS_PER_BATCH) -> DataFrame:
    """The same rows in the order of ``pos``: partitions are ranges of it, in order inside.

    A task fills ``batch_rows`` rows at a time, one chunk after another, and fails if one stays empty.
    """
    source, rect, others, schema = _columns(image, arrays)
    wanted = list(dict.fromkeys(([source] if source else []) + others))
    tasks = tasks or 4 * request.sparkSession.sparkContext.defaultParallelism
    at = _asked(request, placed).join(
        placed.select("session", "chunk_idx", "chunk_path", "lengths", "chunk_version", "frame_base"),
        ["session", "chunk_idx"], "left")
    ranged = at.repartitionByRange(tasks, "pos").sortWithinPartitions("pos")

    def fill(rows: list[dict]) -> pa.RecordBatch:
        chunks: dict[str, list[int]] = {}
        for i, row in enumerate(rows):
            _refuse_missing(row["session"], row["frame_idx"], row["chunk_path"])
            chunks.setdefault(row["chunk_path"], []).append(i)
        images, held = [None] * len(rows), {a: [None] * len(rows) for a in others}
        filled = np.zeros(len(rows), dtype=bool)
        for slots in chunks.values():
            row = rows[slots[0]] | {"lengths": dict(rows[slots[0]]["lengths"])}
            places = np.array([rows[i]["local"] for i in slots])
            for found, data in decode(row, wanted, picks=np.unique(places)):
                cut = _cropped(data, source, rect, row["chunk_path"])
                for i, place in zip(slots, places):
                    k = int(np.searchsorted(found, place))
                    if k < len(found) and found[k] == place:
                        if cut is not None:
                            images[i] = cut[k]
                        for a in others:
                            held[a][i] = data[a][k] if a in data else None
                        filled[i] = True
        if not filled.all():
            raise AssertionError(f"{int((~filled).sum())} of {len(rows)} requests were not served")
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in (
            ("pos", pa.int64()), ("session", pa.string()), ("frame_idx", pa.int64()))]
        columns += [as_binary(np.stack(images))] if source else []
        for a in others:
            columns.append(_column_of(a, held[a]))
        return pa.RecordBatch.from_arrays(
            columns, names=["pos", "session", "frame_idx"] + (["image"] if source else []) + others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for batch in batches:
            waiting += batch.to_pylist()
            while len(waiting) >= batch_rows:
                yield fill(waiting[:batch_rows])
                waiting = waiting[batch_rows:]
        if waiting:
            yield fill(waiting)
    return ranged.mapInArrow(run, schema)


def _column_of(name: str, values: list) -> pa.Array:
    """Rows of several chunks as one column; those of chunks without the array are null."""
    parts = []
    for i, value in enumerate(values):
        if not parts or (value is None) != (parts[-1][0] is None):
            parts.append([])
        parts[-1].append(value)
    return pa.concat_arrays([as_column(name, None if p[0] is None else np.stack(p), len(p)) for p in parts])
