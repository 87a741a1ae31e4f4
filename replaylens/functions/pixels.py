"""Pixel work on image bytes, in Arrow batches next to the scan.

Images never enter a shuffle: each job here maps a batch of image rows to a few
numbers, so only small columns travel on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CENTRE_CROP, FRAME_HW, PROBE_SIZE, RADAR_HW


def resolve_input(spec) -> tuple[str, tuple[int, int, int, int] | None]:
    """Validate an input choice: (column, crop). Bad choices fail before any read."""
    if spec is None or spec == "full":
        return "frames", None
    if spec == "centre":
        return "frames", CENTRE_CROP
    if spec == "radar":
        return "radar", None
    if isinstance(spec, (tuple, list)) and len(spec) == 4:
        top, left, height, width = (int(x) for x in spec)
        if top < 0 or left < 0 or top + height > FRAME_HW[0] or left + width > FRAME_HW[1]:
            raise ValueError(f"crop {spec} falls outside the {FRAME_HW[0]}x{FRAME_HW[1]} frame")
        return "frames", (top, left, height, width)
    raise ValueError(f"unknown input {spec!r}: use 'full', 'centre', 'radar' or (top, left, height, width)")


def input_shape(spec) -> tuple[int, int]:
    """Height and width an input choice serves."""
    column, crop = resolve_input(spec)
    return RADAR_HW if column == "radar" else crop[2:] if crop else FRAME_HW


def cut(images: np.ndarray, rect: tuple[int, int, int, int]) -> np.ndarray:
    """The crop (top, left, height, width) of (rows, height, width, 3)."""
    top, left, height, width = rect
    return images[:, top:top + height, left:left + width]


def as_images(column: pa.Array, hw: tuple[int, int]) -> np.ndarray:
    """A binary Arrow column as (rows, height, width, 3), without copying."""
    size = hw[0] * hw[1] * 3
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(_offsets(column))
    if column.null_count or (lengths != size).any():
        raise ValueError(f"image column must hold {size} bytes per row ({hw[0]}x{hw[1]}x3)")
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    start = int(_offsets(column)[0]) if len(column) else 0
    return data[start:start + size * len(column)].reshape(len(column), hw[0], hw[1], 3)


def _offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=width) if len(column) else np.zeros(1, width)
    return raw[column.offset:column.offset + len(column) + 1]


def as_binary(images: np.ndarray) -> pa.Array:
    """(rows, ...) uint8 as a binary Arrow column over the same memory."""
    images = np.ascontiguousarray(images, dtype=np.uint8)
    n, size = len(images), int(np.prod(images.shape[1:])) if len(images) else 0
    if n * size > 2**31 - 1:
        raise ValueError("image batch is too large for one Arrow column")
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(images)])


def gray(images: np.ndarray) -> np.ndarray:
    """Unweighted mean of the three channels."""
    return images.astype(np.float32).mean(axis=3)


def area_means(img: np.ndarray, size: int) -> np.ndarray:
    """Mean of each cell of a size x size grid over (rows, height, width)."""
    rows, height, width = img.shape
    if height % size == 0 and width % size == 0:
        return img.reshape(rows, size, height // size, size, width // size).mean(axis=(2, 4))
    ys = np.linspace(0, height, size + 1).astype(int)
    xs = np.linspace(0, width, size + 1).astype(int)
    sums = np.add.reduceat(np.add.reduceat(img, ys[:-1], axis=1), xs[:-1], axis=2)
    return sums / (np.diff(ys)[:, None] * np.diff(xs)[None, :])


def _map(df: DataFrame, keep: list[str], column: str, hw, added: str, compute) -> DataFrame:
    """Project to ``keep`` plus the image, and replace the image by computed columns.

    A row without the image fails the job: pass ``df.where("radar IS NOT NULL")`` to leave such rows out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            new = compute(as_images(batch.column(at), hw))
            names = keep + list(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(k)) for k in keep] + list(new.values()), names=names)
    absent = F.raise_error(F.lit(f"a frame has no image in column {column}"))
    picked = df.select(*keep, F.coalesce(F.col(column), absent.cast("binary")).alias(column))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return picked.mapInArrow(run, f"{fields}, {added}")


def radar_variance(df: DataFrame, keep: list[str], column="radar", hw=RADAR_HW) -> DataFrame:
    """Population variance of the gray pixels of each image."""
    def compute(images):
        flat = gray(images).reshape(len(images), -1)
        return {"variance": pa.array(flat.var(axis=1).astype(np.float64))}
    return _map(df, keep, column, hw, "variance DOUBLE", compute)


def radar_features(df: DataFrame, keep: list[str], column="radar", hw=RADAR_HW,
                   size: int = PROBE_SIZE) -> DataFrame:
    """Variance and size x size gray features in [0, 1] in one pass over the images."""
    def compute(images):
        img = gray(images)
        feats = (area_means(img, size) / 255.0).astype(np.float32).reshape(len(images), size * size)
        offsets = pa.array(np.arange(len(images) + 1, dtype=np.int32) * (size * size))
        return {"variance": pa.array(img.reshape(len(images), -1).var(axis=1).astype(np.float64)),
                "features": pa.ListArray.from_arrays(offsets, pa.array(feats.ravel()))}
    return _map(df, keep, column, hw, "variance DOUBLE, features ARRAY<FLOAT>", compute)


def pixel_range(df: DataFrame, keep: list[str], column: str, hw) -> DataFrame:
    """Smallest, largest and summed pixel value of each image."""
    def compute(images):
        flat = images.reshape(len(images), -1)
        return {"px_min": pa.array(flat.min(axis=1).astype(np.int32)),
                "px_max": pa.array(flat.max(axis=1).astype(np.int32)),
                "px_sum": pa.array(flat.sum(axis=1, dtype=np.int64)),
                "px_n": pa.array(np.full(len(images), flat.shape[1], np.int64))}
    return _map(df, keep, column, hw, "px_min INT, px_max INT, px_sum BIGINT, px_n BIGINT", compute)


def crop_images(df: DataFrame, spec, keep: list[str]) -> DataFrame:
    """The chosen input as column ``image``: full frame, crop, or stored radar."""
    column, rect = resolve_input(spec)
    if rect is None:
        return df.select(*keep, df[column].alias("image"))

    def compute(images):
        return {"image": as_binary(cut(images, rect))}
    return _map(df, keep, column, FRAME_HW, "image BINARY", compute)


def upscale_images(df: DataFrame, keep: list[str], column: str, hw, factor: int) -> DataFrame:
    """Nearest-neighbour enlargement, for looking at dumped images."""
    def compute(images):
        return {"image": as_binary(images.repeat(factor, axis=1).repeat(factor, axis=2))}
    return _map(df, keep, column, hw, "image BINARY", compute)
