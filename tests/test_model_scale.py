"""Models on many rows: slopes of all keys in one pass, and no more copies of the rows than fit side by side."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector

from replaylens.operators import probe


def test_slopes_of_all_keys_take_one_pass(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 5)), rng.integers(0, 2, (200, 2))
    rows = spark.createDataFrame([(a.tolist(), int(b[0]), int(b[1])) for a, b in zip(x, y)], "f ARRAY<DOUBLE>, k_w INT, k_a INT")
    calls = []

    class Counted:
        sparkSession = spark

        def select(self, *columns):
            calls.append(columns)
            return rows.repartition(7).withColumn("x", array_to_vector("f")).select(*columns)
    w, b = rng.normal(size=(2, 5)), [0.3, -0.2]
    weights = spark.createDataFrame([("w", w[0].tolist(), b[0]), ("a", w[1].tolist(), b[1])], "key STRING, weights ARRAY<DOUBLE>, intercept DOUBLE")
    got = {(r["key"], r["at"]): r["gradient"] for r in probe.objective_gradient(Counted(), weights, l2=5.0).collect()}
    assert len(calls) == 1 and len(got) == 12
    for i, key in enumerate(("w", "a")):
        miss = 1 / (1 + np.exp(-(x @ w[i] + b[i]))) - y[:, i]
        assert abs(got[key, -1] - miss.mean()) < 1e-12
        for j in range(5):
            assert abs(got[key, j] - (miss @ x[:, j] + 5.0 * w[i, j]) / 200) < 1e-12


def test_fits_side_by_side_are_bounded():
    assert probe.fits_at_once(1000, 32, 6) == 6 and probe.fits_at_once(2_000_000, 32, 6) == 2
    assert probe.fits_at_once(30_000_000, 32, 6) == 1 and probe.fits_at_once(1, 0, 4) == 4
