"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so its size follows the text, sketches
of parts merge into that of the whole by union, and shares of common hashes estimate likeness and containment even
between very unequal texts. A text whose shingles all lie above keeps its least one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .shingles import WordHashes, shingle_hashes

WORDS, SCALE = 5, 16


def sketch(text: str | None, known: WordHashes, words: int = WORDS, scale: int = SCALE) -> np.ndarray:
    """Sorted shingle hashes below 1/scale of the space, or the least one; empty for a text without words."""
    found = shingle_hashes(text, words, known)
    return found[:max(1, int(np.searchsorted(found, np.uint64((1 << 64) // scale))))]


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two parts together (but for shingles over the seam)."""
    both = np.union1d(a, b)
    return both[:max(1, int(np.searchsorted(both, np.uint64((1 << 64) // scale))))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all; 1 for two texts without words, 0 if one has none."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - common
    return common / total if total else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def to_text(found: np.ndarray) -> str:
    """16 hexadecimal digits for each hash, in ascending order."""
    return found.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """``docs`` with the column fingerprint of its text; null and empty texts have an empty one."""
    known = WordHashes()

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([to_text(sketch(t, known, words, scale)) for t in text], dtype=object)
    return docs.withColumn("fingerprint", run("text"))


def in_order(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id and text dealt to partitions by ranges of doc_id, each sorted, with the next range's first rows.

    Rows with ``extra`` belong to a later range (after the last: the first) and stand at the end. Null ids come
    first, equal ids are ordered by text. The driver holds as many ids as there are partitions.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []

    @F.pandas_udf(IntegerType())
    def range_of(doc_id: pd.Series) -> pd.Series:
        found = np.searchsorted(cuts, doc_id.to_numpy(dtype=float, na_value=-np.inf), side="right")
        return pd.Series(found.astype(np.int32))
    ranges = docs.select("doc_id", range_of("doc_id").alias("range"))
    first = {r.range: r.first for r in ranges.groupBy("range").agg(F.min(F.struct("doc_id")).alias("first")).collect()}
    at = sorted(first)
    before = {r: at[i - 1] for i, r in enumerate(at)}
    rows = docs.withColumn("range", range_of("doc_id"))
    if at:  # the first id of a range goes to the range before it as well
        starts = spark.createDataFrame([(r, first[r].doc_id, before[r]) for r in at],
                                       "range int, start long, before int")
        also = rows.join(F.broadcast(starts), ["range"]).where(F.col("doc_id").eqNullSafe(F.col("start")))
        rows = rows.withColumn("extra", F.lit(False)).unionAll(
            also.select("doc_id", "text", F.col("before").alias("range"), F.lit(True).alias("extra")))
    else:
        rows = rows.withColumn("extra", F.lit(False))
    return rows.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("extra", "doc_id", "text")


def compare_with_next(docs: DataFrame, words: int = WORDS, scale: int = SCALE,
                      partitions: int | None = None) -> DataFrame:
    """Fingerprints of each document of ``docs`` (doc_id long, text) and of its text edited with the next one.

    The edit replaces the last n_chars // 2 code points by the first as many (or all) of the next document by
    doc_id; after the last comes the first, and a single document comes after itself. Returns doc_id, n_chars long,
    edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double. Null text counts as
    empty. Rows are kept one for one; other columns are ignored.
    """
    known = WordHashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the row whose next one has not come yet
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for doc_id, text, extra in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                mine = sketch(text, known, words, scale)
                if waiting is not None:
                    row_id, row, its = waiting
                    cut = len(row) // 2
                    edited = row[:len(row) - cut] + text[:cut]
                    other = sketch(edited, known, words, scale)
                    for name, value in zip(names, (row_id, len(row), hashlib.sha256(edited.encode()).hexdigest(),
                                                   to_text(its), to_text(other), likeness(its, other),
                                                   likeness(its, mine))):
                        out[name].append(value)
                    waiting = None
                if extra:
                    break
                waiting = doc_id, text, mine
            yield pa.RecordBatch.from_pydict(out, schema=arrow)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    arrow = pa.schema(list(zip(names, kinds)))
    return in_order(docs, partitions).select("doc_id", "text", "extra").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
