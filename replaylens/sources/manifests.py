"""Session discovery: one row per session folder or bare session file.

Everything runs on listings and small JSON files; no image is opened here.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_FIELDS = {"schema_version": "int", "geom": "string", "loop_fps_target": "int", "chunks": "array<string>",
                   "total_frames": "bigint", "complete": "boolean"}
SESSION_SCHEMA = ("session STRING, path STRING, is_folder BOOLEAN, modified TIMESTAMP, bytes LONG, "
                  "schema_version INT, geom STRING, loop_fps_target INT, chunks ARRAY<STRING>, "
                  "total_frames LONG, complete BOOLEAN, readable BOOLEAN")

NAMES_AT_ONCE = 10_000
_CANDIDATES = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", tz="UTC")), ("bytes", pa.int64()), ("value", pa.string())])

# The reasons as reports name them.
UNREADABLE = "manifest unreadable"
INCOMPLETE = "incomplete (complete=false)"
EMPTY = "no chunks listed (empty session)"


def session_name(path) -> F.Column:
    """Base name of a session path, without ``.npz``."""
    base = F.element_at(F.split(F.rtrim(F.col(path) if isinstance(path, str) else path, F.lit("/")), "/"), -1)
    return F.regexp_replace(base, r"\.npz$", "")


def _files(spark: SparkSession, glob: str) -> DataFrame:
    """Path, size and time of matching files; the content column is never read."""
    try:
        return (spark.read.format("binaryFile").load(glob)
                .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path STRING, modified TIMESTAMP, bytes LONG")


def _spark_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Manifests and bare files as Spark's readers find them: the driver expands the pattern and holds every path."""
    files = _files(spark, f"{root}/*.npz").withColumn("value", F.lit(None).cast("string"))
    try:
        return files.unionByName(spark.read.option("wholetext", True).text(f"{root}/*/manifest.json").select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_size").alias("bytes"), "value"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return files


def _task_candidates(spark: SparkSession, root: str) -> DataFrame:
    """The same from a mounted folder: one task lists its names, and tasks read the manifests. Nothing passes the driver."""
    folder, schema = unquote(urlparse(root).path), "path STRING, modified TIMESTAMP, bytes LONG, value STRING"

    def uri(path: str) -> str:
        return "file://" + quote(path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            names = []
            with os.scandir(folder) as entries:
                for entry in entries:
                    if entry.is_dir() or entry.name.endswith(".npz") and entry.name[0] not in "._":
                        names.append(entry.name)
                    if len(names) == NAMES_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(names)], names=["name"])
                        names = []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column("name").to_pylist():
                path, value = f"{folder}/{name}", None
                if os.path.isdir(path):
                    path += "/manifest.json"
                    if not os.path.exists(path):
                        continue
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        value = f.read()
                status = os.stat(path)
                modified = datetime.fromtimestamp(status.st_mtime_ns // 1_000_000 / 1000, timezone.utc)
                rows.append({"path": uri(path), "modified": modified, "bytes": status.st_size, "value": value})
            yield pa.RecordBatch.from_pylist(rows, schema=_CANDIDATES)
    if not os.path.isdir(folder):
        return spark.createDataFrame([], schema)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.range(1, numPartitions=1).mapInArrow(listed, "name STRING").repartition(tasks, "name").mapInArrow(looked_at, schema)


def _candidates(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, bytes, value): manifests with their text, and bare files without."""
    mounted = urlparse(root).scheme in ("", "file") and not any(c in root for c in "*?[{")
    return (_task_candidates if mounted else _spark_candidates)(spark, root)


def _folders(raw: DataFrame) -> DataFrame:
    """One row per manifest. A field of an unexpected kind is null; only text that is no JSON object is unreadable."""
    raw = raw.where("value IS NOT NULL").select(
        F.try_parse_json("value").alias("_v"), F.col("path").alias("_file"), "modified", "bytes")
    folder = F.regexp_replace("_file", r"/manifest\.json$", "")
    fields = [F.try_variant_get("_v", f"$.{name}", kind).alias(name) for name, kind in MANIFEST_FIELDS.items()]
    return raw.select(
        session_name(folder).alias("session"), folder.alias("path"), F.lit(True).alias("is_folder"), "modified", "bytes",
        *fields, F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)).alias("readable"))


def scan_sessions(spark: SparkSession, root: str) -> DataFrame:
    """All candidates under ``root`` with the reason a session is unusable, if any."""
    found = _candidates(spark, root.rstrip("/"))
    files = found.where("value IS NULL").select(
        session_name("path").alias("session"), "path", F.lit(False).alias("is_folder"), "modified",
        F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("complete"), F.lit(True).alias("readable"))
    return judge(_folders(found).unionByName(files, allowMissingColumns=True))


def judge(sessions: DataFrame) -> DataFrame:
    """Add ``reason``: null for usable sessions. A missing completeness flag passes."""
    return sessions.withColumn(
        "reason",
        F.when(~F.col("readable"), UNREADABLE)
        .when(F.col("complete").eqNullSafe(False), INCOMPLETE)
        .when(F.col("is_folder") & (F.coalesce(F.size("chunks"), F.lit(0)) <= 0), EMPTY))


def usable_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where("reason IS NULL").drop("reason")


def skipped_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where("reason IS NOT NULL").select("session", "path", "reason")


def newest_session(sessions: DataFrame) -> DataFrame:
    """The most recently written session; path breaks ties."""
    newest = sessions.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
    return sessions.join(newest, "path", "left_semi")


def pick_sessions(sessions: DataFrame, wanted: str | None = None) -> DataFrame:
    """All sessions, or the one named by path, base name or name without ``.npz``."""
    if wanted is None:
        return sessions
    name = wanted.rstrip("/").rsplit("/", 1)[-1].removesuffix(".npz")
    return sessions.where((F.col("session") == name) if "/" not in wanted else
                          F.col("path").endswith(wanted.rstrip("/")) | (F.col("session") == name))


def listed_chunks(sessions: DataFrame) -> DataFrame:
    """One row per chunk file the manifest lists, in manifest order; strays are never seen."""
    files = F.when(F.col("is_folder"), F.transform("chunks", lambda c: F.concat_ws("/", "path", c))
                   ).otherwise(F.array("path"))
    return sessions.select("session", F.posexplode(files).alias("chunk_idx", "chunk_path"))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """(session, chunk_idx, bytes) of listed chunks; each file's status is read by an executor task.

    A listed file that does not exist has no size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for uri in batch.column("chunk_path").to_pylist():
                if urlparse(uri).scheme in ("", "file"):
                    files, path = pyarrow.fs.LocalFileSystem(), unquote(urlparse(uri).path)
                else:
                    files, path = pyarrow.fs.FileSystem.from_uri(uri)
                sizes.append(files.get_file_info(path).size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("session"), batch.column("chunk_idx"), pa.array(sizes, pa.int64())],
                names=["session", "chunk_idx", "bytes"])
    tasks = 4 * chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.select("session", "chunk_idx", "chunk_path").repartition(tasks, "chunk_path").mapInArrow(
        run, "session STRING, chunk_idx INT, bytes LONG")


def session_sizes(spark: SparkSession, root: str, sessions: DataFrame) -> DataFrame:
    """Bytes of manifest plus listed chunks. Files that no manifest lists are not looked at."""
    summed = chunk_sizes(listed_chunks(sessions)).groupBy("session").agg(F.sum("bytes").alias("chunk_bytes"))
    return (sessions.join(summed, "session", "left")
            .select("session", (F.col("bytes") + F.coalesce("chunk_bytes", F.lit(0))).alias("total_bytes"))
            .withColumn("size_mb", F.col("total_bytes") / (1024 * 1024)))
