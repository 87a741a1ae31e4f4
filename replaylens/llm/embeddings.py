"""Embedding near-dedup: all pairs of a label with a cosine of at least a threshold, by tiles in PCA order.

Vectors are turned onto the principal axes, so a few leading coordinates hold most of a product. Close vectors are
close on each axis, so bands of the two leading coordinates say which tiles can hold links at all. A pair of tiles
sums the leading coordinates first; the rest of a product is at most the product of the rests' norms, and a pair is
given up once that bound can't reach the threshold. What is left is decided by the cosine in double precision.
A pair of tiles returns counts and one star for each group of linked vectors, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylens.session import written

from .components import connected_components, stars

THRESHOLD, TILE = 0.98, 512
STEPS = (8, 16, 32)  # leading coordinates after which pairs are given up
_SLACK = 1e-9


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes (columns, by falling variance) for each number of dimensions; sums of products are added up by Spark."""
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, part in batch.groupby("d"):
                x = _unit(_matrix(part["vector"]))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pd.DataFrame({"d": d, "at": np.arange(d * d), "value": s.ravel()})
    rows = vectors.select("d", "vector").mapInPandas(products, "d int, at int, value double").groupBy("d", "at").agg(
        F.sum("value").alias("value")).collect()  # the square of the dimensions
    axes = {}
    for d in {r.d for r in rows}:
        s = np.zeros(d * d)
        for r in rows:
            if r.d == d:
                s[r.at] = r.value
        values, found = np.linalg.eigh(s.reshape(d, d))
        axes[d] = found[:, np.argsort(-values, kind="stable")]
    return axes


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of the unit vectors a and b have a cosine of at least ``threshold``."""
    p, q = a @ axes, b @ axes
    at, sums, live = 0, np.zeros((len(a), len(b))), None
    for step in [s for s in STEPS if s < a.shape[1]]:
        rest = np.sqrt((p[:, step:] ** 2).sum(axis=1)), np.sqrt((q[:, step:] ** 2).sum(axis=1))
        if live is None:
            sums += p[:, at:step] @ q[:, at:step].T
            i, j = np.nonzero(sums + np.outer(*rest) >= threshold - _SLACK)
            if 4 * len(i) > sums.size:
                at = step
                continue  # too many to go on one by one
            live, sums = (i, j), sums[i, j]
        else:
            i, j = live
            sums = sums + (p[i, at:step] * q[j, at:step]).sum(axis=1)
            keep = sums + rest[0][i] * rest[1][j] >= threshold - _SLACK
            live, sums = (i[keep], j[keep]), sums[keep]
        at = step
        if not len(live[0]):
            break
    if live is None:
        return a @ b.T >= threshold
    linked = np.zeros((len(a), len(b)), dtype=bool)
    i, j = live
    for s in range(0, len(i), 1 << 15):
        x, y = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
        linked[x, y] = (a[x] * b[y]).sum(axis=1) >= threshold
    return linked


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id integer, embedding, label).

    Vectors are compared when their labels are equal and not null and they have as many dimensions. Vectors that are
    null, empty or zero or hold null or non-finite components link with nothing, nor do rows without a vec_id (their
    component is null and they are not kept). Equal vectors are one class while comparing; n_links counts all others.
    Rows are kept one for one, and rows that share a vec_id are vectors of their own under one id, linked as they are.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vector"),
                          F.coalesce(usable, F.lit(False)).alias("usable"))
    key = F.sha2(F.to_json(F.struct("label", "vector")), 256)
    keyed = rows.withColumn("key", F.when(F.col("usable"), key)).select("vec_id", "key")
    classes = rows.where("usable").groupBy(key.alias("key")).agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"),
        F.first("vector").alias("vector"))
    classes = classes.withColumn("d", F.size("vector"))
    axes = principal_axes(classes)
    band = float(np.sqrt(2 - 2 * threshold)) + 1e-6  # linked unit vectors are no further apart, on any axis
    lead = {d: v[:, :2] for d, v in axes.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bands = np.zeros((len(batch), 2), dtype=np.int64)
            for d, at in batch.groupby("d").indices.items():
                y = _unit(_matrix(batch["vector"].to_numpy()[at])) @ lead[d]
                bands[at, :y.shape[1]] = np.floor(y / band)
            yield batch.assign(b1=bands[:, 0], b2=bands[:, 1])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    placed = classes.mapInPandas(place, f"{fields}, b1 long, b2 long")
    cell = ["label", "d", "b1", "b2"]

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            batch = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            new = (batch[cell] != batch[cell].shift()).any(axis=1).to_numpy()
            start = np.maximum.accumulate(np.where(new, np.arange(len(batch)), 0))
            of = np.cumsum((np.arange(len(batch)) - start) % tile == 0)
            for n, part in batch.groupby(of):
                if n == of[-1]:
                    waiting = part
                else:
                    yield one_tile(part)
        if waiting is not None:
            yield one_tile(waiting)

    def one_tile(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        return pd.DataFrame({c: [first[c]] for c in cell} | {
            "tile": [first["key"]], "reps": [part["rep"].to_numpy()], "sizes": [part["size"].to_numpy()],
            "keys": [part["key"].tolist()], "data": [_matrix(part["vector"]).astype(kind).tobytes()]})
    kind = "<f4" if "float" in vectors.schema["embedding"].dataType.simpleString() else "<f8"
    label = classes.schema["label"].dataType.simpleString()
    ordered = placed.repartitionByRange(*cell, "key").sortWithinPartitions(*cell, "key")
    table = written(ordered.mapInPandas(tiles, f"label {label}, d int, b1 long, b2 long, tile string, "
                                        "reps array<long>, sizes array<long>, keys array<string>, data binary"), "tiles")
    # Pairs of tiles in the same or neighbouring bands, each once.
    near = F.explode(F.array([F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                              for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    ends = table.select(*cell, "tile")
    pairs = ends.select("*", near.alias("o")).select(
        "label", "d", (F.col("b1") + F.col("o.i")).alias("b1"), (F.col("b2") + F.col("o.j")).alias("b2"),
        F.col("tile").alias("x")).join(ends.withColumnRenamed("tile", "y"), cell).where("x <= y").select("x", "y")
    side = lambda name: table.select(F.col("tile").alias(name), *(
        F.col(c).alias(f"{c}_{name}") for c in ("d", "reps", "sizes", "keys", "data")))
    both = pairs.repartition("x", "y").join(side("x"), "x").join(side("y"), "y")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                d = row["d_x"]
                a, b = (_unit(np.frombuffer(row[c], dtype=kind).reshape(-1, d).astype(np.float64))
                        for c in ("data_x", "data_y"))
                linked = tile_links(a, b, axes[d], threshold)
                if row["x"] == row["y"]:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                ra, rb = np.asarray(row["reps_x"]), np.asarray(row["reps_y"])
                found = stars(linked, ra, rb)
                yield pd.DataFrame({"key": None, "n": 0, "a": [m for m, _ in found], "b": [m for _, m in found]})
                sides = [(row["keys_x"], linked @ np.asarray(row["sizes_y"]))]
                if row["x"] != row["y"]:
                    sides.append((row["keys_y"], linked.T @ np.asarray(row["sizes_x"])))
                for keys, n in sides:
                    yield pd.DataFrame({"key": list(keys), "n": n, "a": pd.array([None] * len(n), dtype="Int64"),
                                        "b": pd.array([None] * len(n), dtype="Int64")})
    found = written(both.mapInPandas(compare, "key string, n long, a long, b long"), "links")
    counts = found.where("key is not null and n > 0").groupBy("key").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("a is not null").select("a", "b").distinct().unionAll(
        keyed.join(classes.select("key", "rep"), "key").where("vec_id <> rep").select("vec_id", "rep")))
    of_class = classes.select("key", "size").join(counts, "key", "left")
    out = keyed.join(of_class, "key", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    links = F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("n", F.lit(0))
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
