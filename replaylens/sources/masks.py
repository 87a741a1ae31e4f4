"""Keep-masks: which frames of a session count as gameplay.

A mask is a table beside the recording; the recording itself never changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import index_block
from .chunks import _member, _open, spread
from .generations import next_generation, read_newest, write_generation

MASK_SCHEMA = ("session STRING, frame_idx BIGINT, keep BOOLEAN, variance DOUBLE, threshold DOUBLE, "
               "source_frames BIGINT")


def build_mask(variance: DataFrame, threshold: DataFrame) -> DataFrame:
    """Mask rows from per-frame variance and a one-row ``threshold`` table: kept above it."""
    counted = variance.groupBy("session").agg(F.count(F.lit(1)).alias("source_frames"))
    return (variance.join(counted, "session")
            .withColumn("threshold", threshold.select("threshold").scalar())
            .withColumn("keep", F.col("variance") > F.col("threshold"))
            .select("session", "frame_idx", "keep", "variance", "threshold", "source_frames"))


def rethreshold(mask: DataFrame, threshold: float) -> DataFrame:
    """Apply another cut to the stored variance; no image is read again."""
    return mask.withColumn("threshold", F.lit(float(threshold))).withColumn(
        "keep", F.col("variance") > F.lit(float(threshold)))


def write_mask(mask: DataFrame, path: str) -> None:
    """Replace the masks of exactly the sessions present in ``mask``, all at once.

    They form a generation of the mask table (``sources.generations``): readers see the
    old masks until it is committed, and a failed job leaves them as they are.
    """
    spark = mask.sparkSession
    columns = [c.strip().split(" ")[0] for c in MASK_SCHEMA.split(",")]
    write_generation(mask.select(*columns), path, next_generation(spark, path), [index_block("frame_idx")])


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """The newest stored mask of each session; an absent table is an empty one, as masks are optional."""
    return read_newest(spark, path, MASK_SCHEMA).drop("bucket")


def read_mask_files(sessions: DataFrame) -> DataFrame:
    """Masks stored as ``keep_mask.npz`` in (or, for bare files, beside) a session.

    Missing and unreadable files give no rows.
    """
    where = F.when(F.col("is_folder"), F.concat("path", F.lit("/keep_mask.npz"))).otherwise(
        F.concat(F.regexp_replace("path", r"\.npz$", ""), F.lit(".mask/keep_mask.npz")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with _open(row["chunk_path"]) as z:
                        keep = _member(z, "keep").astype(bool)
                        have = set(z.namelist())
                        source = int(_member(z, "source_frames")) if "source_frames.npy" in have else len(keep)
                        var = (_member(z, "variance").astype(np.float64) if "variance.npy" in have else None)
                        cut = (float(_member(z, "threshold")) if "threshold.npy" in have else None)
                except (OSError, KeyError, ValueError, EOFError) as _:
                    continue
                except Exception as e:
                    if type(e).__name__ == "BadZipFile":
                        continue
                    raise
                n = len(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["session"]] * n, pa.string()), pa.array(np.arange(n), pa.int64()),
                     pa.array(keep), pa.array(var) if var is not None else pa.nulls(n, pa.float64()),
                     pa.array([cut] * n, pa.float64()), pa.array(np.full(n, source, np.int64))],
                    names=["session", "frame_idx", "keep", "variance", "threshold", "source_frames"])
    return spread(sessions.select("session", where.alias("chunk_path"))).mapInArrow(run, MASK_SCHEMA)


def current_mask(mask: DataFrame, lengths: DataFrame) -> DataFrame:
    """Masks built for the session's present length; stale ones are left out.

    ``lengths`` holds (session, n_frames).
    """
    fresh = lengths.select("session", F.col("n_frames").alias("source_frames"))
    return mask.join(fresh, ["session", "source_frames"], "left_semi")
