"""Tables that grow by numbered generations, each of which counts once it is committed.

    root/data/gen=7/bucket=12/...    rows, dealt to a fixed number of session buckets
    root/merged/upto=5/bucket=12/... rows of generations 0 to 5, merged into few files
    root/_commits/...                one row for each of these, written last

Readers take what is committed only, so a job that died half way leaves nothing visible,
and its generation is written again from scratch. A generation that is already committed
is not written twice: a stream's batch that Spark replays after a crash stays as it is.
Sessions share buckets, so the number of folders does not grow with them.

A table is read in one of two ways: all generations together (chunks of a stream), or for
each session the newest one that holds it (masks, frames), which makes replacing some
sessions atomic.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_COMMIT = "gen LONG, upto LONG"


def bucket_of(session: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a session; filter by it to open one session's files only."""
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, root: str) -> tuple[int | None, list[int]]:
    """Up to which generation a merge reaches, and the committed ones after it, in order."""
    found = _table(spark, f"{root}/_commits", _COMMIT)
    upto = found.agg(F.max("upto")).first()[0]
    after = found.where("gen IS NOT NULL") if upto is None else found.where(F.col("gen") > upto)
    return upto, sorted(r["gen"] for r in after.select("gen").collect())


def next_generation(spark: SparkSession, root: str) -> int:
    last = _table(spark, f"{root}/_commits", _COMMIT).agg(F.max("gen")).first()[0]
    return 0 if last is None else last + 1


def _commit(spark: SparkSession, root: str, name: str, gen: int | None, upto: int | None) -> None:
    spark.createDataFrame([(gen, upto)], _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{root}/_commits/at={name}")


def write_generation(rows: DataFrame, root: str, number: int, grain: list[Column] = (),
                     buckets: int = BUCKETS) -> bool:
    """Write and commit one generation; false if it was committed before. One writer at a time.

    ``grain`` spreads the rows of a bucket over several files, such as by chunk.
    """
    spark = rows.sparkSession
    if _table(spark, f"{root}/_commits", _COMMIT).where(F.col("gen") == number).count():
        return False
    dealt = rows.withColumn("bucket", bucket_of(F.col("session"), buckets))
    dealt.repartition("bucket", *grain).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/gen={number}")
    _commit(spark, root, str(number), number, None)
    return True


def _committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of what is committed, with bucket and generation; merged ones have the last merged generation."""
    upto, numbers = commits(spark, root)
    rows = spark.createDataFrame([], f"{schema}, bucket INT, gen LONG")
    if upto is not None:
        rows = _table(spark, f"{root}/merged/upto={upto}", f"{schema}, bucket INT").withColumn("gen", F.lit(upto).cast("long"))
    if numbers:
        # A generation without rows has no files below its folder, so all are listed from above.
        later = _table(spark, f"{root}/data", f"{schema}, bucket INT, gen LONG")
        rows = rows.unionByName(later.where(F.col("gen").isin(numbers)))
    return rows


def read_all(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of all committed generations, with their bucket."""
    return _committed(spark, root, schema).drop("gen")


def read_newest(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """For each session, the rows of the newest committed generation that holds it."""
    rows = _committed(spark, root, schema)
    newest = rows.groupBy("session").agg(F.max("gen").alias("gen"))
    return rows.join(newest, ["session", "gen"], "left_semi").drop("gen")


def merge(spark: SparkSession, root: str, schema: str, newest: bool = False, order: list[str] = ("session",),
          grain: list[Column] = ()) -> int | None:
    """Write what readers see once more, into few, sorted files; the last generation that is in it.

    Readers turn to the merged files when their commit is there. Replayed batches of before are still known.
    """
    upto, numbers = commits(spark, root)
    if not numbers:
        return None
    rows = (read_newest if newest else read_all)(spark, root, schema)
    rows.repartition("bucket", *grain).sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{root}/merged/upto={numbers[-1]}")
    _commit(spark, root, f"upto-{numbers[-1]}", None, numbers[-1])
    return numbers[-1]
