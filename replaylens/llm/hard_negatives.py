"""Hard-negative mining: for each anchor and positive, the best rows of other labels within a window of scores.

Anchors of one label that look alike form a block, and a minimum spanning tree joins them. A row's score at an anchor
differs from its score at the parent by at most the length of the edge times the row's norm, so the parent's score
bounds the child's, and those bounds serve the child's children in turn. Only rows whose bounds overlap the anchor's
window get their exact score; all others are known to lie outside of it.

All rows are dealt to groups of a bounded size by a hash of their id, and every block of anchors visits every group:
a task holds one group and streams the blocks past it. A group returns its own best few for each anchor and positive,
and the best of those are the answer. Anchors are copied to groups, rows move once, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replaylens.session import written

from .whole import Rows, as_longs, finite, scaled

GROUP = 1 << 20  # components of the rows in a group, about
BLOCK = 128  # anchors in a block
_SLACK = 1e-9
_BLOCK_TYPE = "ids array<long>, q array<long>, parent array<int>, edge array<double>, " \
              "positives array<array<long>>, scores array<array<long>>"


def participants(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, d, q) of the rows that take part, one for each vec_id: the least by label, then by vector."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding")
    rows = vectors.where(usable).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min(F.struct(F.col("label").alias("label"), scaled("embedding", scale).alias("q"))).alias("row"))
    return rows.select("vec_id", "row.label", F.size("row.q").alias("d"), "row.q")


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree over the rows: an order with parents first, each row's parent in that order (-1), its edge's length."""
    x = x.astype(np.float64)
    n = len(x)
    order, parent, edge = np.zeros(n, dtype=np.int64), np.full(n, -1), np.zeros(n)
    near, length, place = np.full(n, -1), np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    left = np.ones(n, dtype=bool)
    for k in range(n):
        i = int(np.where(left, length, np.inf).argmin()) if k else 0
        order[k], place[i], left[i] = i, k, False
        if k:
            parent[k], edge[k] = place[near[i]], length[i]
        to = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        closer = left & (to < length)
        near[closer], length[closer] = i, to[closer]
    return order, parent, edge


def anchor_blocks(anchors: DataFrame, block: int) -> DataFrame:
    """Blocks of at most ``block`` anchors of one label and dimension, alike ones together, each with its tree.

    ``anchors``: vec_id, label, d, q, and for each anchor its positives' ids and scores (empty while they are sought).
    """
    label = anchors.schema["label"].dataType.simpleString()
    look = F.transform("q", lambda v: v >= 0)  # near vectors agree on most signs
    parts = max(1, -(-anchors.count() // (8 * block)))
    ordered = anchors.withColumn("look", look).repartitionByRange(parts, "d", "label", "look", "vec_id")
    ordered = ordered.sortWithinPartitions("d", "label", "look", "vec_id").drop("look")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            batch = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            new = (batch[["d", "label"]] != batch[["d", "label"]].shift()).any(axis=1).to_numpy()
            start = np.maximum.accumulate(np.where(new, np.arange(len(batch)), 0))
            of = np.cumsum((np.arange(len(batch)) - start) % block == 0)
            for n, part in batch.groupby(of):
                if n == of[-1]:
                    waiting = part
                else:
                    yield one(part)
        if waiting is not None:
            yield one(waiting)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.asarray(v, dtype=np.int64) for v in part["q"]], dtype=np.int64).reshape(
            len(part), int(part["d"].iloc[0]))
        order, parent, edge = spanning_tree(x)
        part = part.iloc[order]
        return pd.DataFrame({
            "label": [part["label"].iloc[0]], "d": [part["d"].iloc[0]], "ids": [part["vec_id"].to_numpy()],
            "q": [x[order].ravel()], "parent": [parent], "edge": [edge],
            "positives": [[list(v) for v in part["positives"]]], "scores": [[list(v) for v in part["scores"]]]})
    return ordered.mapInPandas(build, f"label {label}, d int, {_BLOCK_TYPE}")


def tree_scores(anchors: np.ndarray, parent, edge, rows: Rows, norms: np.ndarray, window) -> Iterator[tuple]:
    """(i, at, scores) for each anchor i: the rows that may lie in its window, and their exact scores.

    ``window(i, low)`` gives the least and the greatest score of use, from lower bounds of all rows' scores.
    """
    children = np.bincount(np.asarray(parent)[1:], minlength=len(anchors)) if len(anchors) > 1 else [0]
    children, bounds, n = list(children), {}, len(norms)
    for i, (p, length) in enumerate(zip(parent, edge)):
        if p < 0:
            low, high = np.full(n, -np.inf), np.full(n, np.inf)
        else:
            low, high = bounds[p]
            reach = length * norms * (1 + _SLACK) + _SLACK * np.maximum(np.abs(low), np.abs(high))
            low, high = low - reach, high + reach
            children[p] -= 1
            if not children[p]:
                del bounds[p]  # no more than the open branches are held
        least, greatest = window(i, low)
        at = np.flatnonzero((high >= least) & (low <= greatest))
        if 4 * len(at) > n or p < 0:  # one full product is cheaper than picking rows, and gives sharper bounds below
            scores = rows.products(anchors[i])
            low = high = scores.astype(np.float64)
            scores = scores[at]
        else:
            scores = rows.products(anchors[i], at)
            low[at] = high[at] = scores.astype(np.float64)
        if children[i]:
            bounds[i] = low, high
        yield i, at, scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by falling score, ties by rising id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    at = np.arange(len(ids))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Group:
    """The rows of a group and one dimension, picked by label when a block asks for them."""

    def __init__(self, parts: list[pd.DataFrame], d: int):
        self.ids = np.concatenate([p["id"].to_numpy() for p in parts]).astype(np.int64)
        self.labels = np.concatenate([p["label"].to_numpy() for p in parts])
        self.x = np.array([v for p in parts for v in p["q"]], dtype=np.int64).reshape(len(self.ids), d)
        self._last = None

    def picked(self, label, same: bool) -> tuple[np.ndarray, Rows, np.ndarray]:
        if self._last is None or self._last[0] != label:  # blocks come ordered by label
            mask = (self.labels == label) if same else (self.labels != label)
            x = self.x[mask]
            self._last = label, (self.ids[mask], Rows(x), np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)))
        return self._last[1]


def positives_of(block, group: Group, k: int) -> Iterator[tuple]:
    """(anchor, None, None, id, score) for each anchor's first k other rows of its label in this group."""
    ids, rows, norms = group.picked(block.label, same=True)
    anchors = np.asarray(block.q, dtype=np.int64).reshape(len(block.ids), int(block.d))

    def window(i, low):  # at least k others have these scores or more
        low = low[ids != block.ids[i]]
        return (np.partition(low, -k)[-k] if len(low) >= k else -np.inf), np.inf
    for i, at, scores in tree_scores(anchors, block.parent, block.edge, rows, norms, window):
        others = ids[at] != block.ids[i]
        at, scores = at[others], scores[others]
        first = best(scores, ids[at], k)
        yield from ((block.ids[i], None, None, a, s) for a, s in zip(ids[at[first]], as_longs(scores[first])))


def negatives_of(block, group: Group, k: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive, its score, id, score) for each positive's first k rows of other labels in this group."""
    ids, rows, norms = group.picked(block.label, same=False)
    anchors = np.asarray(block.q, dtype=np.int64).reshape(len(block.ids), int(block.d))
    ranges = [[(-(-low * int(s) // 100), high * int(s) // 100) for s in scores] for scores in block.scores]

    def window(i, _):
        return min((a for a, _ in ranges[i]), default=np.inf), max((b for _, b in ranges[i]), default=-np.inf)
    for i, at, scores in tree_scores(anchors, block.parent, block.edge, rows, norms, window):
        for positive, score, (least, greatest) in zip(block.positives[i], block.scores[i], ranges[i]):
            inside = np.flatnonzero((scores >= least) & (scores <= greatest))
            first = inside[best(scores[inside], ids[at[inside]], k)]
            yield from ((block.ids[i], positive, score, a, s)
                        for a, s in zip(ids[at[first]], as_longs(scores[first])))


def _visit(rows: DataFrame, blocks: DataFrame, groups: int, answer) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score): what every block of anchors finds in every group of rows."""
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    sides = rows.select(group.alias("g"), "d", F.lit(0).alias("kind"), "label", F.col("vec_id").alias("id"), "q")
    dealt = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(1))
    both = sides.unionByName(dealt, allowMissingColumns=True).repartition(groups, "g").sortWithinPartitions(
        "g", "d", "kind", "label")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, parts, group = None, [], None
        for batch in batches:
            keys = batch[["g", "d"]]
            cut = (keys != keys.shift()).any(axis=1).to_numpy() | (batch["kind"] == 1).to_numpy()
            starts = np.flatnonzero(cut)
            starts = starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts])
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                part = batch.iloc[a:b]
                if held != (key := (part["g"].iloc[0], part["d"].iloc[0])):
                    held, parts, group = key, [], None
                if part["kind"].iloc[0] == 0:
                    parts.append(part[["id", "label", "q"]])
                elif parts:
                    group = group or Group(parts, int(key[1]))
                    found = list(answer(next(part.itertuples()), group))
                    yield pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score", "id", "score"]
                                       ).astype({"positive_id": "Int64", "positive_score": "Int64"})
    return both.mapInPandas(compare, "anchor_id long, positive_id long, positive_score long, id long, score long")


def mine(vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 10, window=(30, 90),
         scale: int = 256, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id (integer), label and embedding; other columns are not read. ``anchor`` says of a vec_id
    whether its row is an anchor. Components become floor(scale * x), a score is the exact inner product with the
    anchor, higher ones come first and ties by the smaller vec_id. An anchor's positives are its first ``n_positives``
    other rows of its label, all if fewer; an anchor without one has no rows. A positive's negatives are the first
    ``n_negatives`` rows of other labels with window[0] % to window[1] % of its score, so a positive with a negative
    score has none. Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Rows
    that share a vec_id count as one, the least by label, then by vector. Vectors are compared with those of as many
    components, empty ones among themselves. Equal vectors under different ids are rows of their own. Components and
    scores beyond the range of longs become the nearest long.
    """
    rows = written(participants(vectors, scale), "rows")
    anchors = rows.where(anchor)
    size = rows.agg(F.sum(F.greatest("d", F.lit(1)))).first()[0] or 0
    groups = max(1, -(-size // group))
    nothing = [F.array().cast("array<long>").alias(c) for c in ("positives", "scores")]
    blocks = anchor_blocks(anchors.select("*", *nothing), block)
    found = _visit(rows, blocks, groups, lambda b, g: positives_of(b, g, n_positives))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_positives)
    found = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("id", "score")).alias("p"))
    anchors = written(anchors.join(found, "vec_id").select(
        "vec_id", "label", "d", "q", F.col("p.id").alias("positives"), F.col("p.score").alias("scores")), "anchors")
    blocks = anchor_blocks(anchors, block)
    found = _visit(rows, blocks, groups, lambda b, g: negatives_of(b, g, n_negatives, *window))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def oracle_sql() -> str:
    """The rules of the query, pair by pair."""
    return """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
           from embeddings
           where label is not null and embedding is not null
             and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)) || [false])),
p as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
             list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint as score
      from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (select anchor_id, id as positive_id, score as positive_score from p where same
              qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id,
       row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank,
       id as negative_id, positive_score, score as negative_score
from positives join p using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 10"""
