"""Toxicity: nearest labelled examples by TF-IDF cosine over a block-max inverted index.

Terms are chosen on labelled rows by the likelihood ratio of their document counts in both classes, so cosines
speak of what separates the classes. The examples' postings are cut into blocks of like examples, each with the
largest weight of every term; a query visits blocks from the highest bound down and stops once no block can
still reach its k-th neighbour. That leaves the neighbours exact. Votes are weighted by cosine and by how far the
bounded sample thinned a class, so a score estimates the share of toxic documents among such texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The model is fitted on at most this many labelled rows of each class, the ones with the lowest hash.
MAX_EXAMPLES = 4096
#: Terms need this likelihood ratio and this many documents.
LEAST_G2, LEAST_DOCS = 15.1, 3
NEIGHBOURS, BLOCK, SHARPNESS, PRIOR_VOTES = 25, 64, 2.0, 0.1
THRESHOLD = 0.7
#: Queries of more terms add up whole posting lists; the neighbours are the same.
FEW_TERMS = 2

_SPACED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Words in lower case: runs of letters, digits and any non-ASCII characters."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def features(word: bytes) -> list[bytes]:
    """A word and its beginnings of 3 to 8 bytes (marked by ``-``), so that inflected forms count together."""
    return [word] + [word[:k] + b"-" for k in range(3, min(9, len(word)))]


class Terms(dict):
    """Word -> positions of its chosen features; remembers a bounded number of words."""

    def __init__(self, at: dict[bytes, int]):
        super().__init__()
        self.at = at

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = tuple(self.at[f] for f in features(word) if f in self.at)
        return found

    def count(self, text: str | None) -> Counter:
        return Counter(i for w in words(text) if (hit := self[w]) for i in hit)

    def __reduce__(self):
        return Terms, (self.at,)


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many toxic and other texts each feature occurs, summed by batch."""
    for batch in batches:
        seen = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.text, batch.toxic):
            seen[toxic].update({f for w in set(words(text)) for f in features(w)})
        terms = list(seen[0] | seen[1])
        yield pd.DataFrame({"term": terms, "a": [seen[1][t] for t in terms], "b": [seen[0][t] for t in terms]})


@F.pandas_udf(LongType())
def _shingle_set(text: pd.Series) -> pd.Series:
    """A hash of the set of a text's five-word shingles (of all its words if there are fewer)."""
    def whole(t):
        w = words(t)
        found = {xxhash.xxh3_64_intdigest(b" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))}
        return xxhash.xxh3_64_intdigest(np.array(sorted(found), dtype=np.uint64).tobytes()) - (1 << 63)
    return pd.Series([whole(t) for t in text], dtype="int64")


class Index:
    """Examples as unit vectors over the chosen terms, in blocks with the largest weight of each term."""

    def __init__(self, terms: list[bytes], idf, counts: list[dict[int, int]], toxic, ids, weight: tuple[float, float]):
        self.terms = Terms({t: i for i, t in enumerate(terms)})
        self.idf = np.asarray(idf, dtype=np.float64)
        vectors = [self.weights(c) for c in counts]  # (terms, weights) of each example
        order = np.array(sorted(range(len(counts)), key=lambda i: (
            [*zip(vectors[i][0].tolist(), (-vectors[i][1]).tolist()), (len(terms), 0.0)], ids[i])), dtype=int)
        self.toxic = np.asarray(toxic, dtype=np.float64)[order]
        self.ids = np.asarray(ids, dtype=np.int64)[order]
        self.weight = np.where(self.toxic > 0, weight[1], weight[0])
        total = self.weight.sum()
        self.prior = float((self.weight * self.toxic).sum() / total) if total else 0.0
        vectors = [vectors[i] for i in order]
        some = np.array([len(at) > 0 for at, _ in vectors], dtype=bool)
        empty = ~some
        w = self.weight[empty]
        self.blank = float(((w * self.toxic[empty]).sum() + PRIOR_VOTES * self.prior) / (w.sum() + PRIOR_VOTES))
        self.toxic, self.ids, self.weight = (x[some] for x in (self.toxic, self.ids, self.weight))
        vectors = [v for v in vectors if len(v[0])]
        n = len(vectors)
        self.starts = list(range(0, n, BLOCK))
        self.postings = []  # per block: term -> (rows, weights)
        most: dict[int, list[tuple[int, float]]] = {}  # term -> its blocks with their largest weight
        for b, s in enumerate(self.starts):
            part = vectors[s:s + BLOCK]
            at = np.concatenate([t for t, _ in part])
            by_term = np.argsort(at, kind="stable")
            row = np.repeat(np.arange(len(part)), [len(t) for t, _ in part])[by_term]
            weights = np.concatenate([w for _, w in part])[by_term]
            found, first = np.unique(at[by_term], return_index=True)
            self.postings.append({t: (r, w) for t, r, w in zip(
                found.tolist(), np.split(row, first[1:]), np.split(weights, first[1:]))})
            for t, (_, w) in self.postings[b].items():
                most.setdefault(t, []).append((b, w.max()))
        self.most = {t: (np.array([b for b, _ in x]), np.array([w for _, w in x])) for t, x in most.items()}
        self.whole = {t: tuple(np.concatenate(x) for x in zip(*(
            (self.postings[b][t][0] + self.starts[b], self.postings[b][t][1]) for b in blocks.tolist())))
            for t, (blocks, _) in self.most.items()}  # term -> (rows, weights) over all blocks
        self.size = n
        self.known: dict[bytes, tuple[float, list[int]]] = {}

    def weights(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The terms in ``counts``, ascending, and their weights in the unit vector."""
        at = np.array(sorted(counts), dtype=int)
        w = (1 + np.log(np.array([counts[i] for i in at.tolist()], dtype=np.float64))) * self.idf[at]
        norm = np.sqrt((w * w).sum())
        return at, w / norm if norm else w

    def vector(self, counts: dict[int, int]):
        v = np.zeros(len(self.idf))
        at, w = self.weights(counts)
        v[at] = w
        return v

    def nearest(self, v, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a cosine above 0; ties go to the lower row."""
        at = np.flatnonzero(v)
        return self.nearest_to(at, v[at], k)

    def nearest_to(self, at, weights, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` of the vector with ``weights`` of the terms ``at``."""
        query = [(t, w) for t, w in zip(at.tolist(), weights.tolist()) if t in self.most]
        if len(query) > FEW_TERMS:  # bounds of many terms leave hardly a block out
            score = np.zeros(self.size)
            for t, w in query:
                score[self.whole[t][0]] += w * self.whole[t][1]
            rows = np.flatnonzero(score > 0)
            cosines = np.round(score[rows], 12)
            if len(rows) > k:
                near = cosines >= np.partition(cosines, -k)[-k]
                rows, cosines = rows[near], cosines[near]
            top = np.lexsort((rows, -cosines))[:k]
            return rows[top], cosines[top]
        bound = np.zeros(len(self.starts))
        for t, w in query:
            blocks, most = self.most[t]
            bound[blocks] += w * most
        rows, cosines = np.zeros(0, int), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(rows) == k and bound[b] < cosines[-1] - 1e-12:
                break
            s = self.starts[b]
            score = np.zeros(min(BLOCK, self.size - s))
            for t, w in query:
                if hit := self.postings[b].get(t):
                    score[hit[0]] += w * hit[1]
            some = np.flatnonzero(score > 0)
            rows, cosines = np.concatenate([rows, some + s]), np.concatenate([cosines, np.round(score[some], 12)])
            top = np.lexsort((rows, -cosines))[:k]
            rows, cosines = rows[top], cosines[top]
        return rows, cosines

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """Score and the doc_ids of the nearest examples, for one text."""
        counts = self.terms.count(text)
        if not counts:
            return self.blank, []
        key = repr(sorted(counts.items())).encode()
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            rows, cosines = self.nearest_to(*self.weights(counts))
            votes = cosines ** SHARPNESS * self.weight[rows]
            score = ((votes * self.toxic[rows]).sum() + PRIOR_VOTES * self.prior) / (votes.sum() + PRIOR_VOTES)
            self.known[key] = float(score), self.ids[rows[:3]].tolist()
        return self.known[key]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """The index over at most ``max_examples`` labelled rows of each class that are not held out.

    What reaches the driver is bounded by the examples: the terms that pass among theirs, and their term counts. Labels other than 0 and 1 and
    null ids are left out; a page with both labels counts as toxic.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * max_examples ids
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # Copies of a text are one case of its words: of those with the same set of shingles, and so of words, one counts.
    rows = texts.groupBy("toxic", _shingle_set("text").alias("same")).agg(F.min("text").alias("text"))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    counts = rows.mapInPandas(_document_counts, "term binary, a long, b long").groupBy("term").agg(
        F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    df = F.col("a") + F.col("b")

    def part(seen: Column, size: float, share: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (size * share))).otherwise(0.0)
    g2 = 2 * (part(F.col("a"), n1, df / (n1 + n0)) + part(F.col("b"), n0, df / (n1 + n0))
              + part(n1 - F.col("a"), n1, 1 - df / (n1 + n0)) + part(n0 - F.col("b"), n0, 1 - df / (n1 + n0)))
    best = counts.where(df >= LEAST_DOCS).select("term", df.alias("df"), g2.alias("g2")).where(
        F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "term").collect() if n1 and n0 else []
    terms, idf = [bytes(r.term) for r in best], [float(np.log(1 + (n1 + n0) / r.df)) for r in best]
    at = {t: i for i, t in enumerate(terms)}

    chosen_terms = Terms(at)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sorted(chosen_terms.count(t).items()) for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id, "toxic": b.toxic, "terms": [[i for i, _ in x] for x in found],
                                "n": [[c for _, c in x] for x in found]})
    got = texts.mapInPandas(vectors, "doc_id long, toxic int, terms array<int>, n array<int>").collect()
    got.sort(key=lambda r: r.doc_id)
    in_sample = Counter(r.toxic for r in got)
    weight = tuple(sizes.get(c, 0) / in_sample[c] if in_sample[c] else 0.0 for c in (0, 1))
    return Index(terms, idf, [dict(zip(r.terms, r.n)) for r in got], [r.toxic for r in got],
                 [r.doc_id for r in got], weight)


def score_documents(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score double, predicted int and evidence array<long> (nearest examples), one row per row.

    Only the text is looked at. Null and empty texts score as examples without any of the terms do. Repeated rows
    stay. Columns of ``docs`` named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most 2 * MAX_EXAMPLES sparse vectors

    @F.pandas_udf("struct<score: double, evidence: array<long>>")
    def judge(text: pd.Series) -> pd.DataFrame:
        found = [shared.value.score(t) for t in text]
        return pd.DataFrame({"score": [s for s, _ in found], "evidence": [e for _, e in found]})
    out = docs.withColumn("__judged", judge(F.col("text")))
    return out.withColumns({"score": F.col("__judged.score"), "evidence": F.col("__judged.evidence"),
                            "predicted": (F.col("__judged.score") >= threshold).cast("int")}).drop("__judged")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int, evidence for every document."""
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


