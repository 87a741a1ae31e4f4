"""Registered queries on stored tables, reports, file sizes, and models scored and checked."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylens.fixed_values import MOVEMENT_KEYS
from replaylens.functions import actions
from replaylens.operators import probe, validate
from replaylens.plans import cleaning, training
from replaylens.session import shared_folder, written
from replaylens.sources import manifests, masks, tables

from . import views as v
from .queries import _MASK, _OTSU, _mask, _probe_rows, _split, query, rounded
from .stored import _put


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/sinks-{uuid.uuid4().hex}"


# Masks of every fourth session are written again with another cut; every fifth session has grown by a frame since.
@query("""select session, frame_idx, variance > case when session::int % 4 = 0 then 300 else round(threshold, 4) end as keep,
  case when session::int % 4 = 0 then 300.0::double else round(threshold, 4) end as threshold from mk where session::int % 5 <> 0""", _MASK)
def mask_roundtrip(spark, d):
    """Masks written, some replaced, read again, and left out where the session has another length."""
    path = _folder(spark)
    first = written(_mask(spark, d), "mask").withColumn("threshold", F.round("threshold", 4))
    masks.write_mask(first, path)
    masks.write_mask(masks.rethreshold(first.where(F.col("session").cast("int") % 4 == 0), 300.0), path)
    grown = F.when(F.col("session").cast("int") % 5 == 0, 1).otherwise(0)
    lengths = first.groupBy("session").agg(F.count(F.lit(1)).alias("n")).select("session", (F.col("n") + grown).alias("n_frames"))
    return masks.current_mask(masks.read_mask(spark, path), lengths).select("session", "frame_idx", "keep", "threshold")


@query("""select session, frame_idx, cast(floor(frame_idx / 50) as int) as chunk_idx, dx + case when user_id % 4 = 0 then 1000 else 0 end as dx
  from f where user_id % 4 > 0 or frame_idx % 2 = 0""", v.FRAMES)
def frames_table(spark, d):
    """Sessions stored as a table; every fourth one replaced by another version with fewer frames."""
    path = _folder(spark)
    frames = v.frames(spark, d).select("session", "frame_idx", "dx")
    tables.replace_sessions(frames, path, 50)
    other = frames.where("cast(session as int) % 4 = 0 and frame_idx % 2 = 0").withColumn("dx", F.col("dx") + 1000)
    tables.replace_sessions(other, path, 50)
    return tables.read_sessions(spark, path, "session STRING, frame_idx LONG, dx INT, chunk_idx INT")


@query("""select session, 1::bigint as mask_schema, n as total_frames, kept, n - kept as dropped, round((n - kept) / n, 6) as dropped_frac,
  round(threshold, 4) as threshold_variance, chunk_lengths from (select session, count(*) as n, count(*) filter (keep) as kept,
  max(threshold) as threshold from mk group by 1) join (select session, string_agg(n::varchar, ',' order by c) as chunk_lengths from
  (select session, frame_idx // 20 as c, count(*) as n from mk group by 1, 2) group by 1) using (session)""", _MASK)
def stored_clean_report(spark, d):
    """The report of a clean as it is stored, read back from JSON."""
    path = _folder(spark)
    mask = _mask(spark, d)
    chunks = mask.select("session", F.floor(F.col("frame_idx") / 20).alias("chunk_idx"))
    cleaning.write_report(cleaning.stored_report(mask, chunks), path)
    report = spark.read.json(path)
    return report.withColumns({"chunk_lengths": F.array_join(F.transform("chunk_lengths", lambda x: x.cast("string")), ","),
                               "threshold_variance": F.round("threshold_variance", 4), "dropped_frac": F.round("dropped_frac", 6)})


@query("""select count(*) as n, count(distinct session) as n_sessions, min(variance) as lowest, median(variance) as median, max(variance) as highest,
  round(max(threshold), 4) as threshold, 'otsu split' as reason,
  avg(lv) filter (lv > thr_log) - avg(lv) filter (lv <= thr_log) >= 1.5 as bimodal,
  count(*) filter (variance <= threshold) as n_blank, count(*) filter (variance > threshold) as n_kept from v, o4""", _OTSU)
def clean_preview(spark, d):
    return cleaning.preview(v.variance(spark, d))[0].withColumn("threshold", F.round("threshold", 4))


def _write_sized(root: str):
    """Files of a known number of bytes in place of chunks: their status is what is asked for."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _put(f"{root}/{row.session}/chunk_{row.chunk_idx:05d}.npz", bytes(row.size))
            yield batch[["session"]]
    return write


@query("""select session, sum(size)::bigint + 7 as total_bytes, round((sum(size) + 7) / 1048576, 9) as size_mb from (
  select session, chunk_idx, 1000 + sum(k) as size from f group by 1, 2) group by 1""", v.FRAMES)
def session_sizes(spark, d):
    """Sizes of manifests of 7 bytes and their chunk files."""
    root = _folder(spark)
    sized = written(v.frames(spark, d).groupBy("session", "chunk_idx").agg((F.sum("k") + 1000).cast("long").alias("size")), "sized")
    sized.mapInPandas(_write_sized(root), "session string").write.format("noop").mode("overwrite").save()
    files = sized.groupBy("session").agg(F.array_sort(F.collect_list(F.format_string("chunk_%05d.npz", "chunk_idx"))).alias("chunks"))
    sessions = files.select("session", F.concat(F.lit(f"{root}/"), F.col("session")).alias("path"), F.lit(True).alias("is_folder"),
                            F.lit(7).cast("long").alias("bytes"), "chunks")
    return rounded_mb(manifests.session_sizes(spark, root, sessions))


def rounded_mb(df: DataFrame) -> DataFrame:
    return df.withColumn("size_mb", F.round("size_mb", 9))


# ---- models ----------------------------------------------------------------------

_WIDTH = 64


def _load_model():
    """A fixed linear model of two keys and two look axes; weight j of output i is ((7 j + 3 i) % 11 - 5) / 5."""
    j, i = np.arange(_WIDTH)[:, None], np.arange(4)[None]
    weights = ((7 * j + 3 * i) % 11 - 5) / 5.0

    def predict(x):
        z = x @ weights
        return np.concatenate([1 / (1 + np.exp(-z[:, :2])), z[:, 2:]], axis=1)
    return predict


def _scored(spark, d) -> DataFrame:
    windows = v.table(spark, d, "embeddings").select(
        (F.col("vec_id") % 20).cast("string").alias("session"), F.col("vec_id").alias("last_idx"), F.col("embedding").alias("features"),
        (F.col("label") < 3).cast("int").alias("k_w"), (F.col("label") % 2 == 0).cast("int").alias("k_a"),
        (F.get("embedding", F.lit(4)).cast("double") * 40).alias("dx"), (F.get("embedding", F.lit(5)).cast("double") * 20).alias("dy"))
    return training.score_windows(windows, _load_model, ["w", "a"], width=_WIDTH)


_Z = ", ".join(f"list_sum(list_transform(range(0, {_WIDTH}), lambda j: embedding[j + 1]::double * (((7 * j + {3 * i}) % 11) - 5) / 5.0)) as z{i}"
               for i in range(4))
_SCORED = f"""sc as (select 1 / (1 + exp(-z0)) as p1, 1 / (1 + exp(-z1)) as p2, z2 as lx, z3 as ly, tx, ty, y1, y2 from (
  select {_Z}, embedding[5]::double * 40 as tx, embedding[6]::double * 20 as ty, case when label < 3 then 1.0 else 0.0 end as y1,
  case when label % 2 = 0 then 1.0 else 0.0 end as y2 from embeddings))"""


@query("""select name, round(a, 4) as a, round(b, 4) as b, round(c, 4) as c, round(d, 4) as d from (
  select 'key w' as name, avg(y1) as a, avg((p1 >= 0.4)::int) as b, sum((p1 >= 0.4)::int * y1) / greatest(sum((p1 >= 0.4)::int), 1e-9) as c, avg(p1) as d from sc
  union all select 'key a', avg(y2), avg((p2 >= 0.4)::int), sum((p2 >= 0.4)::int * y2) / greatest(sum((p2 >= 0.4)::int), 1e-9), avg(p2) from sc
  union all select 'look dx', stddev_pop(tx), stddev_pop(lx), corr(tx, lx), avg(lx) from sc
  union all select 'look dy', stddev_pop(ty), stddev_pop(ly), corr(ty, ly), avg(ly) from sc)""", _SCORED)
def model_diagnosis(spark, d):
    """A model that Spark does not know, loaded once per worker, scored in batches and diagnosed."""
    found = training.diagnose(_scored(spark, d), lambda rows: rows, ["w", "a"], sample=1_000_000)
    keys = found["keys"].select(F.concat(F.lit("key "), F.col("key")).alias("name"), F.col("true_rate").alias("a"),
                                F.col("pred_rate").alias("b"), F.col("precision").alias("c"), F.col("mean_prob").alias("d"))
    look = found["look"].select(F.concat(F.lit("look "), F.col("axis")).alias("name"), F.col("truth_std").alias("a"),
                                F.col("pred_std").alias("b"), F.col("corr").alias("c"), F.col("pred_mean").alias("d"))
    return keys.unionByName(look).withColumns({c: F.round(c, 4) for c in "abcd"})


@query(f"""select key, feature::int as feature, 0.0::double as gradient from (select unnest(['w', 'a', 's', 'd']) as key),
  (select unnest(range(-1, {_WIDTH})) as feature)""")
def probe_gradient(spark, d):
    """The slope of the penalised loss in every weight of the linear probe; 0 where the fit is the optimum."""
    rows = _probe_rows(spark, d)
    lengths = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n_frames"))
    out = training.run_probe(rows, lengths, balanced=True)
    slopes = probe.objective_gradient(out["scaled"].where("side = 'train'"), out["weights"])
    return slopes.withColumn("gradient", F.abs(F.round("gradient", 5))).withColumnRenamed("at", "feature")


@query(f"""select key, feature::int as feature, 0.0::double as gradient, true as converged from (select unnest({MOVEMENT_KEYS}) as key),
  (select unnest(range(-1, 32)) as feature)""")
def baseline_gradient(spark, d):
    """The same for the movement baseline's keys, with the table of its fits."""
    f = v.frames(spark, d).withColumn("features", F.transform(
        F.concat(actions.action_vector(), F.array(F.col("health").cast("float"))), lambda x: x / 50))
    narrow = f.select("session", "frame_idx", "dx", "dy", "features", *actions.key_columns(MOVEMENT_KEYS))
    out = training.run_baseline(narrow, _split(spark, d), length=4, times=2)
    slopes = probe.objective_gradient(out["fit_rows"], out["weights"])
    return slopes.join(out["fit"].select("key", "converged"), "key").withColumn(
        "gradient", F.abs(F.round("gradient", 3))).withColumnRenamed("at", "feature")


@query("""select session, frame_idx, bad from (select cast(user_id as varchar) as session, frame_idx, k % 40 = 0 or k % 41 = 0 as bad from f) where bad""",
       v.FRAMES)
def not_finite_features(spark, d):
    """Frames whose features hold a NaN or an infinity."""
    odd = F.when(F.col("k") % 40 == 0, F.lit(float("nan"))).when(F.col("k") % 41 == 0, F.lit(float("-inf"))).otherwise(F.col("dx"))
    f = v.frames(spark, d).select("session", "frame_idx", F.array(F.lit(1.0), odd.cast("double")).alias("features"))
    return validate.not_finite(f).select("session", "frame_idx", F.lit(True).alias("bad"))


@query("""select round(avg(dx), 6) as dx_mean, round(avg(dy), 6) as dy_mean, round(greatest(stddev_pop(dx), 1), 6) as dx_std,
  round(greatest(stddev_pop(dy), 1), 6) as dy_std from f""", v.FRAMES)
def look_stats_table(spark, d):
    """Look statistics stored with their floor and read again."""
    path = _folder(spark)
    stats = v.frames(spark, d).agg(*[g(a).alias(f"{a}_{n}") for a in ("dx", "dy") for n, g in (("mean", F.avg), ("std", F.stddev_pop))])
    tables.write_look_stats(stats, path)
    return rounded(tables.read_look_stats(spark, path), "dx_mean", "dy_mean", "dx_std", "dy_std")
