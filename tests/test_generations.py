"""Tables of committed generations: appended, replaced session by session, replayed and merged."""

import os

from pyspark.sql import functions as F

from replaylens.sources import generations as g
from replaylens.streaming import metrics

SCHEMA = "session STRING, x INT"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def seen(df):
    return sorted((r["session"], r["x"]) for r in df.collect())


def test_append_replay_and_merge(spark, tmp_path):
    root = str(tmp_path / "t")
    assert seen(g.read_all(spark, root, SCHEMA)) == [] and g.next_generation(spark, root) == 0
    assert g.merge(spark, root, SCHEMA) is None
    assert g.write_generation(rows(spark, ("a", 1), ("b", 2)), root, 0)
    assert not g.write_generation(rows(spark, ("a", 99)), root, 0)  # a replayed batch
    assert g.write_generation(rows(spark), root, 1) and g.write_generation(rows(spark, ("a", 3)), root, 2)
    assert seen(g.read_all(spark, root, SCHEMA)) == [("a", 1), ("a", 3), ("b", 2)]
    # A job that died before its commit: its files are there, its rows are not.
    rows(spark, ("dead", 7)).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{root}/data/gen=3")
    assert len(seen(g.read_all(spark, root, SCHEMA))) == 3
    assert g.merge(spark, root, SCHEMA, order=["session", "x"]) == 2
    assert seen(g.read_all(spark, root, SCHEMA)) == [("a", 1), ("a", 3), ("b", 2)]
    assert g.commits(spark, root) == (2, [])
    assert not g.write_generation(rows(spark, ("a", 99)), root, 2)
    assert g.write_generation(rows(spark, ("c", 4)), root, 3)
    assert seen(g.read_all(spark, root, SCHEMA)) == [("a", 1), ("a", 3), ("b", 2), ("c", 4)]
    one = g.read_all(spark, root, SCHEMA).where(F.col("bucket") == g.bucket_of(F.lit("c")))
    assert seen(one) == [("c", 4)]
    assert len(os.listdir(f"{root}/data/gen=3")) <= 4  # the dead job's folder was written anew


def test_newest_generation_of_each_session(spark, tmp_path):
    root = str(tmp_path / "t")
    g.write_generation(rows(spark, ("a", 1), ("a", 2), ("b", 3)), root, g.next_generation(spark, root))
    g.write_generation(rows(spark, ("a", 4)), root, g.next_generation(spark, root))
    assert seen(g.read_newest(spark, root, SCHEMA)) == [("a", 4), ("b", 3)]
    g.merge(spark, root, SCHEMA, newest=True)
    assert seen(g.read_newest(spark, root, SCHEMA)) == seen(g.read_all(spark, root, SCHEMA)) == [("a", 4), ("b", 3)]
    g.write_generation(rows(spark, ("b", 5), ("b", 6)), root, g.next_generation(spark, root))
    assert seen(g.read_newest(spark, root, SCHEMA)) == [("a", 4), ("b", 5), ("b", 6)]


def test_metrics_take_a_replayed_batch_once(spark, tmp_path):
    path = str(tmp_path / "m")
    assert metrics.running_totals(metrics.read_metrics(spark, path)).count() == 0
    stored = [("q", "r1", 0, "recording", "2026-01-01", 5, 5, 1, 2.0, 4, 0.5), ("q", "r1", 1, "recording", "2026-01-02", 3, 3, 0, 1.0, 3, 0.1),
              ("q", "r2", 1, "recording", "2026-01-03", 3, 3, 0, 1.0, 3, None)]
    spark.createDataFrame(stored, metrics.METRICS_SCHEMA).write.parquet(path)
    row = metrics.running_totals(metrics.read_metrics(spark, path)).first()
    assert (row["last_batch"], row["frames"], row["long_gaps"], row["max_state_age"]) == (1, 8, 1, 0.5)
    assert abs(row["fps"] - 7 / 3) < 1e-12
