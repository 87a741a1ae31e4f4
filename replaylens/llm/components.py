"""Connected components by alternating large and small stars, each round a few shuffles of narrow rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylens.session import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of one orderable type); component is the least node.

    Edges may repeat, point either way, and join a node to itself; null ends are left out. A round hooks every larger
    neighbour of a node, then every smaller one, to the least of them; rounds grow with the logarithm of the longest
    path. Each round is a table in the shared folder, so that lineage stays short and a lost executor costs one round.
    A node with very many neighbours is only ever grouped by a map-side minimum.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = pairs.where("u = v").select("u", "v")
    pairs = written(pairs.where("u > v").distinct().unionAll(nodes.distinct()), "edges")
    loops, pairs = pairs.where("u = v"), pairs.where("u > v")
    before = None
    while (now := _state(pairs)) != before:
        before = now
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
        pairs = written(small.where("u > v").distinct(), "edges")
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        pairs.select("v", "v")).unionAll(loops.select("u", "v"))
    return found.groupBy("node").agg(F.min("component").alias("component"))


def stars(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> list[tuple[int, int]]:
    """(member, least id) of each group that a matrix of links between a's and b's forms: never more than members."""
    out, left = [], linked.any(axis=1)
    while left.any():
        rows = np.zeros(len(left), dtype=bool)
        rows[left.argmax()] = True
        while True:
            cols = linked[rows].any(axis=0)
            more = linked[:, cols].any(axis=1)
            if not (more & ~rows).any():
                break
            rows |= more
        members = np.concatenate([ids_a[rows], ids_b[cols]])
        least = int(members.min())
        out += [(int(m), least) for m in members]
        left &= ~rows
    return out
