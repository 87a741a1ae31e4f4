"""Centroid clustering of whole-number vectors with heap-ordered bounds.

Each block of vectors keeps a heap for each cluster. A vector's entry is the gap between its distance to the second
nearest and to the nearest centroid, plus the drift that its cluster had gathered by then. A round adds to a cluster's
drift how far its own centroid moved and how far any other one moved; while an entry is above the drift, no centroid
can have become nearer. So only entries that the drift has reached are popped, and only their vectors are compared with
all centroids again, exactly. A block returns what its moved vectors change in the clusters' sums, never the vectors.

A round is one pass over the blocks without a shuffle, and its blocks are a table in the shared folder, so a lost
executor costs some tasks of one round. Only the centroids and changes of their sums pass through the driver.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylens.session import written

from .whole import as_longs, finite, kind_for, most, scaled, squared_distances

BLOCK = 4096
_SLACK, _ROUNDING = 1e-9, 1e-12
_STATE = "ids array<long>, q array<long>, sizes array<int>, keys array<double>, members array<int>, change array<long>, " \
         "scanned long"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties: the smaller number), and a lower bound of the gap to the next one."""
    d2 = squared_distances(x, centroids)
    at = d2.argmin(axis=1)
    if len(centroids) == 1:
        return at, np.full(len(x), np.inf)
    roots = np.sqrt(np.sort(d2, axis=1)[:, :2].astype(np.float64))
    return at, roots[:, 1] * (1 - _SLACK) - roots[:, 0] * (1 + _SLACK)


def change_of(x: np.ndarray, old: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """What rows that move from cluster old (-1: none) to new add to counts and sums, by cluster.

    Sums are split into high and low halves of 32 bits, so that adding up blocks stays within longs.
    """
    d = x.shape[1]
    out = np.zeros((k, 1 + 2 * d), dtype=np.int64)
    parts = np.concatenate([np.ones((len(x), 1), dtype=np.int64), x >> 32, x & 0xFFFFFFFF], axis=1)
    np.add.at(out, new, parts)
    left = old >= 0
    np.subtract.at(out, old[left], parts[left])
    return out.ravel()


def rescan(x: np.ndarray, heaps: list[list], drift: list[float], centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Pop the entries that the drift has reached, and put their vectors where they belong now."""
    at, old = [], []
    for c, heap in enumerate(heaps):
        while heap and heap[0][0] <= drift[c] * (1 + _ROUNDING):
            at.append(heapq.heappop(heap)[1])
            old.append(c)
    if not at:
        return np.zeros(len(centroids) * (1 + 2 * x.shape[1]), dtype=np.int64), 0
    new, gaps = nearest(x[at], centroids)
    for i, c, gap in zip(at, new.tolist(), gaps.tolist()):
        heapq.heappush(heaps[c], (gap + drift[c], i))
    old = np.array(old)
    moved = old != new
    return change_of(x[at][moved], old[moved], new[moved], len(centroids)), len(at)


def _row(ids, q, heaps, change, scanned) -> pd.DataFrame:
    return pd.DataFrame({
        "ids": [ids], "q": [q], "sizes": [np.array([len(h) for h in heaps], dtype=np.int32)],
        "keys": [np.array([key for h in heaps for key, _ in h])],
        "members": [np.array([i for h in heaps for _, i in h], dtype=np.int32)], "change": [change],
        "scanned": [scanned]})


def _heaps(row) -> list[list]:
    """A heap is its array, so the stored order is a heap again."""
    ends = np.cumsum(row.sizes)
    entries = list(zip(np.asarray(row.keys).tolist(), np.asarray(row.members).tolist()))
    return [entries[e - n:e] for e, n in zip(ends.tolist(), np.asarray(row.sizes).tolist())]


class Centroids:
    """Centroids as Python integers, with counts, sums and drifts; at most k * d numbers, on the driver."""

    def __init__(self, first: list[list[int]]):
        self.at, k, d = first, len(first), len(first[0])
        self.n, self.sums, self.drift = [0] * k, [[0] * d for _ in range(k)], [0.0] * k

    def array(self) -> np.ndarray:
        return np.array(self.at, dtype=np.int64)  # means of longs are longs

    def update(self, blocks: DataFrame) -> None:
        """Add the changes that the blocks report, and move the centroids to the floors of their means."""
        k, d = len(self.at), len(self.at[0])
        added = blocks.select(F.posexplode("change").alias("at", "value")).where("value <> 0").groupBy("at").agg(
            F.sum("value").alias("value")).collect()
        for at, value in added:
            c, j = divmod(at, 1 + 2 * d)
            if j == 0:
                self.n[c] += value
            else:
                self.sums[c][(j - 1) % d] += value << (32 if j <= d else 0)
        before, moves = self.at, []
        self.at = [[s // n for s in sums] if n else old for n, sums, old in zip(self.n, self.sums, before)]
        for old, new in zip(before, self.at):
            moves.append(sum((a - b) ** 2 for a, b in zip(old, new)) ** 0.5)
        for c in range(k):
            others = max((m for i, m in enumerate(moves) if i != c), default=0.0)
            self.drift[c] += (moves[c] + others) * (1 + _SLACK)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.at]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, seed: int = 2, scale: int = 256,
            block: int = BLOCK, report: list | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each vector that is kept.

    Kept are rows of ``vectors`` (vec_id integer, embedding; other columns are not read) with a vec_id and exactly
    ``dimensions`` components, none null or non-finite; components become floor(scale * x), at most the range of longs.
    The first centroids are the k vectors (all, if fewer) with the least sha256 of "seed:vec_id", ties by vector.
    Each round assigns every vector to the nearest centroid, ties to the smaller number, then moves each centroid to
    the floor of its vectors' mean; one without vectors stays. A last assignment follows. Rows are kept one for one:
    repeated rows and rows that share a vec_id are vectors of their own. Distances and sums beyond longs become the
    largest long. ``report`` gets the number of vectors that each assignment compared with all centroids.
    """
    q = scaled("embedding", scale)
    kept = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dimensions) & finite("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = [list(r.q) for r in kept.orderBy(name, "q").limit(k).collect()]
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], empty)
    centroids = Centroids(first)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = []
        for batch in batches:
            for s in range(0, len(batch), block):
                waiting.append(batch.iloc[s:s + block])
                if sum(map(len, waiting)) >= block:
                    yield one(pd.concat(waiting))
                    waiting = []
        if waiting:
            yield one(pd.concat(waiting))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["q"].tolist(), dtype=np.int64)
        at, gaps = nearest(x, now)
        heaps = [[] for _ in now]
        for i, (c, gap) in enumerate(zip(at.tolist(), gaps.tolist())):
            heaps[c].append((gap, i))
        for heap in heaps:
            heapq.heapify(heap)
        return _row(part["vec_id"].to_numpy(), x.ravel(), heaps, change_of(x, np.full(len(x), -1), at, len(now)), len(x))
    now = centroids.array()
    blocks = written(kept.mapInPandas(begin, _STATE), "clusters")
    for _ in range(rounds):
        if report is not None:
            report.append(blocks.agg(F.sum("scanned")).first()[0])
        centroids.update(blocks)
        blocks = written(_next(blocks, centroids), "clusters")
    if report is not None:
        report.append(blocks.agg(F.sum("scanned")).first()[0])
    now = centroids.array()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                x = np.asarray(row.q, dtype=np.int64).reshape(len(row.ids), -1)
                of = np.zeros(len(x), dtype=np.int32)
                of[row.members] = np.repeat(np.arange(len(now)), row.sizes)
                kind = kind_for(x.shape[1] * (most(x) + most(now)) ** 2)
                away = ((x.astype(kind) - now[of].astype(kind)) ** 2).sum(axis=1)
                yield pd.DataFrame({"vec_id": row.ids, "cluster": of, "distance": as_longs(away)})
    rows = written(blocks.select("ids", "q", "sizes", "members").mapInPandas(
        measure, "vec_id long, cluster int, distance long"), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    whole, digests, top = sum(int(r["sum"]) for r in sums), centroids.digests(), (1 << 63) - 1
    totals = vectors.sparkSession.createDataFrame(
        [(r.cluster, min(int(r["sum"]), top), min(whole, top), digests[r.cluster]) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(totals), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _next(blocks: DataFrame, centroids: Centroids) -> DataFrame:
    now, drift = centroids.array(), list(centroids.drift)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                heaps = _heaps(row)
                x = np.asarray(row.q, dtype=np.int64).reshape(len(row.ids), -1)
                change, scanned = rescan(x, heaps, drift, now)
                yield _row(row.ids, row.q, heaps, change, scanned)
    return blocks.mapInPandas(again, _STATE)


def oracle_sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Every vector against every centroid in every round."""
    text = f"""
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and len(embedding) = 64
    and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
c0 as materialized (select (row_number() over (order by sha256('{seed}:' || vec_id::varchar)) - 1)::int as c, q from v
                    qualify c < {k})"""
    near = """
a{i} as materialized (
  select vec_id, v.q, (min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda j:
      (v.q[j] - c.q[j]) * (v.q[j] - c.q[j])))::bigint, c := c.c))) as best from v, c{i} c group by 1, 2)"""
    mean = """
s{i} as materialized (
  select c, j, sum(x)::hugeint as s, count(*) as n from (
    select best.c as c, unnest(q) as x, unnest(range(1, 65)) as j from a{i}) group by 1, 2),
c{n} as materialized (
  select o.c, coalesce(m.q, o.q) as q from c{i} o left join (
    select c, list((s - ((s % n) + n) % n) // n order by j)::bigint[] as q from s{i} group by 1) m using (c))"""
    for i in range(rounds):
        text += "," + near.format(i=i) + "," + mean.format(i=i, n=i + 1)
    text += "," + near.format(i=rounds)
    return text + f"""
select vec_id, best.c as cluster, best.d as distance, sum(best.d) over (partition by best.c)::bigint as cluster_inertia,
       sum(best.d) over ()::bigint as inertia,
       sha256(array_to_string(list_transform(c.q, lambda x: x::varchar), ',')) as centroid_sha256
from a{rounds} join c{rounds} c on c.c = best.c"""
