"""Checks on sessions and frames. Each returns the rows that explain its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MANDATORY_ARRAYS, OPTIONAL_ARRAYS, SUPPORTED_VERSIONS
from ..functions.numeric import finite
from ..functions.state import kind_label


def unsupported_chunks(headers: DataFrame) -> DataFrame:
    """Chunks of a format version these readers do not know."""
    return headers.where(F.col("chunk_version").isNotNull()
                         & ~F.col("chunk_version").isin(SUPPORTED_VERSIONS))


def header_alignment(headers: DataFrame) -> DataFrame:
    """Per session: do all per-frame arrays have equal length, in every chunk?

    Decided from chunk headers, so it runs before any image is read. An optional
    array must be in all chunks or in none.
    """
    n = F.col("lengths")["frames"]
    checks = []
    for name in MANDATORY_ARRAYS + OPTIONAL_ARRAYS:
        have = F.col("lengths")[name]
        checks.append(F.sum(F.coalesce(have, F.lit(0))).alias(f"len_{name}"))
        bad = have.isNotNull() & (have != n)
        if name in MANDATORY_ARRAYS:
            bad = bad | have.isNull()
        checks.append(F.max(bad.cast("int")).alias(f"_bad_{name}"))
        checks.append(F.count(have).alias(f"_in_{name}"))
    agg = headers.groupBy("session").agg(F.sum(n).alias("n_frames"), F.count(F.lit(1)).alias("n_chunks"), *checks)
    wrong = [F.when((F.col(f"_bad_{a}") > 0)
                    | ~F.col(f"_in_{a}").isin(0) & (F.col(f"_in_{a}") < F.col("n_chunks")), F.lit(a))
             for a in MANDATORY_ARRAYS + OPTIONAL_ARRAYS]
    out = agg.withColumn("misaligned", F.array_compact(F.array(*wrong)))
    keep = ["session", "n_frames", "n_chunks"] + [f"len_{a}" for a in MANDATORY_ARRAYS + OPTIONAL_ARRAYS]
    return out.select(*keep, "misaligned", (F.size("misaligned") == 0).alias("aligned"))


def alignment(frames: DataFrame, mandatory: list[str], optional: list[str] = ()) -> DataFrame:
    """The same test on a frames table: non-null counts against the row count."""
    agg = frames.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_frames"),
        *[F.count(c).alias(f"n_{c}") for c in [*mandatory, *optional]])
    ok = F.lit(True)
    for c in mandatory:
        ok = ok & (F.col(f"n_{c}") == F.col("n_frames"))
    for c in optional:
        ok = ok & ((F.col(f"n_{c}") == 0) | (F.col(f"n_{c}") == F.col("n_frames")))
    return agg.withColumn("aligned", ok)


def chunk_lengths(frames: DataFrame) -> DataFrame:
    """Frames per chunk of each session, in chunk order."""
    per_chunk = frames.groupBy("session", "chunk_idx").agg(F.count(F.lit(1)).alias("n"))
    return per_chunk.groupBy("session").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", "n"))), lambda x: x["n"]).alias("chunk_lengths"))


def session_lengths(sessions: DataFrame, counted: DataFrame) -> DataFrame:
    """Manifest length, counted length (session, n_counted) and whether they differ."""
    return (sessions.join(counted.select("session", "n_counted"), "session", "left")
            .select("session", "total_frames", F.coalesce("n_counted", F.lit(0)).alias("n_counted"),
                    F.coalesce("total_frames", "n_counted", F.lit(0)).alias("n_frames"))
            .withColumn("mismatch", F.coalesce(F.col("total_frames") != F.col("n_counted"), F.lit(False))))


def counted_frames(headers: DataFrame) -> DataFrame:
    return headers.groupBy("session").agg(F.sum(F.col("lengths")["frames"]).alias("n_counted"))


def empty_sessions(sessions: DataFrame, frames: DataFrame) -> DataFrame:
    """Sessions without a single frame."""
    return sessions.join(frames.select("session"), "session", "left_anti")


def without_radar(sessions: DataFrame, headers: DataFrame) -> DataFrame:
    """Sessions that stored no minimap images."""
    have = headers.where(F.map_contains_key("lengths", F.lit("radar"))).select("session")
    return sessions.join(have, "session", "left_anti").select("session")


def require_radar(sessions: DataFrame, headers: DataFrame, named: int = 20) -> None:
    """Refuse minimap input before any image is read if some session lacks it."""
    missing = without_radar(sessions, headers)
    names = [r["session"] for r in missing.orderBy("session").limit(named).collect()]
    if names:
        raise ValueError(f"input 'radar': {missing.count()} session(s) have no radar array: {names}")


def kind(version: str = "schema_version", is_folder: str = "is_folder") -> Column:
    return kind_label(F.col(version), F.col(is_folder))


def not_served_once(request: DataFrame, served: DataFrame, keys: list[str]) -> DataFrame:
    """Requested rows that were served never or more than once."""
    marks = (request.select(*keys, F.lit(1).alias("_asked"), F.lit(0).alias("_got"))
             .unionByName(served.select(*keys, F.lit(0).alias("_asked"), F.lit(1).alias("_got"))))
    return (marks.groupBy(*keys).agg(F.sum("_asked").alias("asked"), F.sum("_got").alias("served"))
            .where("asked <> served"))


def not_finite(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows whose features hold a NaN or an infinity."""
    return df.where(F.exists(features, lambda x: ~finite(x)))


def checked_features(df: DataFrame, features: str = "features") -> DataFrame:
    """Pass rows through; fail the job at the first non-finite feature."""
    bad = F.exists(features, lambda x: ~finite(x))
    return df.withColumn(features, F.when(bad, F.raise_error(F.lit("features hold non-finite values")))
                         .otherwise(F.col(features)))


def shared_sessions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sessions on both sides of a split; must be empty."""
    return a.select("session").intersect(b.select("session"))


def geometry_groups(sessions: DataFrame) -> DataFrame:
    """How many sessions share each capture geometry; more than one row needs a look."""
    return sessions.groupBy("geom").agg(F.count(F.lit(1)).alias("n_sessions"))
