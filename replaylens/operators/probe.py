"""Linear models on window or image features, fitted by MLlib."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import FEATURE_STD_FLOOR, PROBE_L2
from .validate import checked_features

#: Fits side by side hold at most this many feature values together (each keeps its own copy of the rows); one fit may hold more.
VALUES_AT_ONCE = 1 << 27


def fits_at_once(rows: int, width: int, limit: int) -> int:
    """How many fits run side by side: all of them on few rows, one where a fit alone fills the cluster."""
    return max(1, min(limit, VALUES_AT_ONCE // max(1, rows * width)))


def feature_scale(train: DataFrame, features: str = "features", floor: float = FEATURE_STD_FLOOR) -> DataFrame:
    """One row: mean and floored population deviation of each feature, and n.

    Summarized in trees of partial results, so width times partitions is all that
    moves.
    """
    vec = array_to_vector(F.col(features).cast("array<double>"))
    s = train.agg(Summarizer.metrics("mean", "std", "count").summary(vec).alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std"), F.col("s.count").alias("n"))
    population = F.sqrt((F.col("n") - 1) / F.col("n"))
    return s.select("n", "mean", F.transform("std", lambda x: F.greatest(x * population, F.lit(floor))).alias("std"))


def scale(df: DataFrame, scaling: DataFrame, features: str = "features") -> DataFrame:
    """Standardize features with the TRAIN row, as an ML vector column ``x``."""
    row = scaling.agg(F.struct(F.first("mean").alias("mean"), F.first("std").alias("std")).alias("s")).scalar()
    z = F.zip_with(F.zip_with(F.col(features).cast("array<double>"), "_s.mean", lambda v, m: v - m),
                   "_s.std", lambda v, s: v / s)
    return df.withColumn("_s", row).withColumn("x", array_to_vector(z)).drop("_s")


def fit_keys(train: DataFrame, keys: list[str], l2: float = PROBE_L2, max_iter: int = 200,
             tol: float = 1e-9, weight: str | None = None, parallelism: int = 8):
    """One L2 logistic model per key; returns {key: model} and a convergence table.

    ``train`` needs ``x`` and one ``k_<key>`` column per key. The penalty is l2 / n
    and leaves the intercept free. A key with a single class has no model: its
    constant is the prediction.
    """
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector_to_array("x"))), F.lit(0)).alias("_width"), *[F.avg(f"k_{k}").alias(k) for k in keys]).first()
    def fit(k: str):
        if stats[k] in (0.0, 1.0):
            return float(stats[k]), (k, 0.0, 0.0, True)
        lr = LogisticRegression(featuresCol="x", labelCol="_y", regParam=l2 / stats["n"], elasticNetParam=0.0,
                                standardization=False, maxIter=max_iter, tol=tol)
        if weight:
            lr = lr.setWeightCol(weight)
        model = lr.fit(train.withColumn("_y", F.col(f"k_{k}").cast("double")))
        history = list(model.summary.objectiveHistory)
        first, last = float(history[0]), float(history[-1])
        return model, (k, first, last, last == last and last <= first + 1e-6)

    if stats["n"] == 0:
        raise ValueError("no training rows")
    # On few rows an iteration is a short job, and fits side by side keep the cluster busy.
    with ThreadPool(fits_at_once(stats["n"], stats["_width"], min(len(keys), parallelism))) as pool:
        done = pool.map(inheritable_thread_target(train.sparkSession)(fit), keys)
    models = {k: model for k, (model, _) in zip(keys, done)}
    table = train.sparkSession.createDataFrame(
        [row for _, row in done], "key STRING, loss_first DOUBLE, loss_last DOUBLE, converged BOOLEAN")
    return models, table


def key_weights(spark: SparkSession, models: dict) -> DataFrame:
    """(key, weights, intercept) of the fitted models; a key with a single class has none."""
    rows = [(k, [float(w) for w in m.coefficients], float(m.intercept)) for k, m in models.items() if not isinstance(m, float)]
    return spark.createDataFrame(rows, "key STRING, weights ARRAY<DOUBLE>, intercept DOUBLE")


def objective_gradient(train: DataFrame, weights: DataFrame, l2: float = PROBE_L2) -> DataFrame:
    """(key, at, gradient): the slope of the penalised loss in each weight, the intercept at -1; all 0 at the optimum.

    ``train`` has the scaled vector ``x`` and ``k_<key>`` columns. One pass for all keys: each task sums
    (p - y) * x over its batches, so that keys times width is all that moves.
    """
    rows = weights.collect()  # a row per key
    if not rows:
        return train.sparkSession.createDataFrame([], "key STRING, at INT, gradient DOUBLE")
    keys = [r["key"] for r in rows]
    w, b = np.array([r["weights"] for r in rows]), np.array([r["intercept"] for r in rows])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(keys), w.shape[1] + 1)), 0
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, -1)
            y = np.stack([batch.column(f"k_{k}").to_numpy() for k in keys])
            miss = 1 / (1 + np.exp(-(w @ x.T + b[:, None]))) - y
            total[:, 1:] += miss @ x
            total[:, 0] += miss.sum(axis=1)
            n += batch.num_rows
        at = np.arange(-1, w.shape[1])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(keys, len(at)).tolist()), pa.array(np.tile(at, len(keys)), pa.int32()),
            pa.array(total.ravel()), pa.array(np.full(total.size, n), pa.int64())], names=["key", "at", "s", "n"])
    narrow = train.select(vector_to_array("x").alias("_x"), *[F.col(f"k_{k}").cast("double").alias(f"k_{k}") for k in keys])
    found = narrow.mapInArrow(sums, "key STRING, at INT, s DOUBLE, n LONG").groupBy("key", "at").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"))
    pulled = train.sparkSession.createDataFrame(
        [(k, j, float(v)) for k, row in zip(keys, w) for j, v in enumerate(row)], "key STRING, at INT, w DOUBLE")
    return found.join(F.broadcast(pulled), ["key", "at"], "left").select(
        "key", "at", ((F.col("s") + F.lit(l2) * F.coalesce("w", F.lit(0.0))) / F.col("n")).alias("gradient"))


def predict_keys(df: DataFrame, models: dict, keys: list[str]) -> DataFrame:
    """Add ``probs`` (one probability per key) and ``truth``."""
    out = df
    for i, k in enumerate(keys):
        model = models[k]
        if isinstance(model, float):
            out = out.withColumn(f"_p{i}", F.lit(model))
        else:
            out = (model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_v{i}").transform(out)
                   .withColumn(f"_p{i}", F.get(vector_to_array(f"_v{i}"), F.lit(1))).drop(f"_v{i}"))
    return (out.withColumn("probs", F.array(*[f"_p{i}" for i in range(len(keys))]))
            .withColumn("truth", F.array(*[F.col(f"k_{k}").cast("int") for k in keys]))
            .drop(*[f"_p{i}" for i in range(len(keys))]))


def fit_look(train: DataFrame, l2: float = PROBE_L2, weight: str | None = None) -> list:
    """One ridge model per look axis on standardized targets ``dx_z`` and ``dy_z``."""
    n = train.count()
    models = []
    for axis in ("dx_z", "dy_z"):
        lr = LinearRegression(featuresCol="x", labelCol=axis, regParam=l2 / max(n, 1), elasticNetParam=0.0,
                              standardization=False, solver="l-bfgs")
        models.append((lr.setWeightCol(weight) if weight else lr).fit(train))
    return models


def predict_look(df: DataFrame, models: list) -> DataFrame:
    out = df
    for i, model in enumerate(models):
        out = model.setPredictionCol(f"_look{i}").transform(out)
    return (out.withColumn("look_pred", F.array(*[f"_look{i}" for i in range(len(models))]))
            .withColumn("look_true", F.array(F.col("dx").cast("double"), F.col("dy").cast("double")))
            .drop(*[f"_look{i}" for i in range(len(models))]))


def window_features(windows: DataFrame, gathered: str = "w_features") -> DataFrame:
    """Summarize a window of frame features as their mean and last-minus-first difference."""
    first = F.get(gathered, F.lit(0))
    n = F.size(gathered)
    total = F.aggregate(F.slice(gathered, 2, n), first.cast("array<double>"),
                        lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b.cast("double")))
    mean = F.transform(total, lambda v: v / n)
    diff = F.zip_with(F.element_at(gathered, -1), first, lambda a, b: (a - b).cast("double"))
    return windows.withColumn("features", F.concat(mean, diff)).drop(gathered)


def probe_features(df: DataFrame, scaling: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Check, scale and return (scaled rows, scaling row)."""
    good = checked_features(df)
    scaling = scaling if scaling is not None else feature_scale(good)
    return scale(good, scaling), scaling
