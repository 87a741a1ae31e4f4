"""Hard negatives, centroid clustering and line dedup against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from replaylens.llm import clustering, hard_negatives, line_dedup
from replaylens.llm.whole import Rows, squared_distances

VECTOR = "vec_id long, label int, embedding array<double>, id long, q string, d int, rank int, cluster int, ids string"
EXTRA = (1, "q", 2, 3, 4, "ids")


def _vectors(seed, n, d=64, spread=0.3):
    """Vectors around a few centres, with copies, odd rows and values far beyond 64-bit products."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = [(int(i), int(i % 4), (centres[i % 6] + rng.normal(size=d) * spread).tolist()) for i in range(n)]
    rows += [(n + i, i % 4, rows[i * 7 % n][2]) for i in range(30)]  # equal vectors
    rows += [rows[3], rows[10], rows[10]]  # equal rows
    rows += [(900, 1, None), (901, None, rows[1][2]), (None, 1, rows[2][2]), (902, 2, [None] + rows[1][2][1:]),
             (903, 2, [math.nan] + rows[1][2][1:]), (904, 2, [math.inf] + rows[1][2][1:]), (905, 2, rows[1][2][:5]),
             (910, 1, rows[4][2][:5]), (906, 1, []), (920, 2, []), (907, 0, [0.0] * d), (908, 3, [1e9] * d),
             (909, 3, [-1e9] + [1e9] * (d - 1)), (30, 3, rows[50][2]), (930, 3, [1e300] * d)]
    random.Random(seed).shuffle(rows)
    return rows


def _ints(v):
    return [min(max(math.floor(256 * x) if abs(x) < 1e300 else int(math.copysign(2**63, x)), -2**63), 2**63 - 1) for x in v]


def _usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _long(n):
    return min(max(n, -2**63), 2**63 - 1)


def _mined(rows, step, n_pos, n_neg):
    """All scores of all anchors, in Python integers."""
    least = {}
    for i, label, v in rows:
        if i is not None and label is not None and _usable(v):
            least[i] = min(least.get(i, (label, _ints(v))), (label, _ints(v)))
    out = set()
    for a, (la, qa) in least.items():
        if a % step:
            continue
        scores = sorted((-sum(map(int.__mul__, qa, q)), i, label) for i, (label, q) in least.items()
                        if i != a and len(q) == len(qa))
        for p, positive in [(-s, i) for s, i, label in scores if label == la][:n_pos]:
            p = _long(p)
            inside = [(-s, i) for s, i, label in scores if label != la and 30 * p <= -100 * s <= 90 * p]
            out |= {(a, positive, k + 1, i, p, _long(s)) for k, (s, i) in enumerate(inside[:n_neg])}
    return out


@pytest.mark.parametrize("group, block", [(1 << 20, 128), (1500, 3)])
def test_hard_negatives(spark, group, block):
    rows = _vectors(1, 240)
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], VECTOR).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0, group=group, block=block).collect()
    assert Counter(map(tuple, got)) == Counter(_mined(rows, 5, 5, 10))
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") < 0).count() == 0


def test_tree_bounds_spare_rows():
    """Anchors close together: nearly all rows outside of the window are never scored, and none inside is missed."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(2000, 32)) * 60).astype(np.int64)
    anchors = x[:1] + rng.integers(-1, 2, size=(40, 32))
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    assert parent[0] == -1 and (parent[1:] < np.arange(1, 40)).all()
    scored = 0
    for i, at, scores in hard_negatives.tree_scores(
            anchors[order], parent, edge, Rows(x), np.sqrt((x ** 2).sum(axis=1)), lambda i, low: (30_000, 60_000)):
        exact = x @ anchors[order][i]
        assert set(np.flatnonzero((exact >= 30_000) & (exact <= 60_000))) <= set(at)
        assert (scores == exact[at]).all()
        scored += len(at) if i else 0
    assert scored < 0.35 * 39 * len(x)


def _clusters(rows, k, rounds, d, seed=2):
    kept = [(i, _ints(v)) for i, _, v in rows if i is not None and _usable(v) and len(v) == d]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [q for _, q in first]

    def assign():
        out = []
        for _, q in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres)))
        return out
    for _ in range(rounds):
        of = assign()
        for c in range(len(centres)):
            own = [q for (_, q), (_, n) in zip(kept, of) if n == c]
            if own:
                centres[c] = [sum(v) // len(own) for v in zip(*own)]
    of = assign()
    total = {c: _long(sum(x for x, n in of if n == c)) for c in range(len(centres))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, _long(x), total[c], _long(sum(x for x, _ in of)), name[c]) for (i, _), (x, c) in zip(kept, of))


@pytest.mark.parametrize("k, rounds, block", [(40, 5, 4096), (7, 4, 13), (1, 2, 50), (2000, 2, 4096)])
def test_clustering(spark, k, rounds, block):
    rows = [r for r in _vectors(2, 200, d=16) if r[0] != 930 or k == 7]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], VECTOR).repartition(3)
    got = clustering.cluster(df, k, rounds, 16, block=block)
    assert Counter(map(tuple, got.collect())) == _clusters(rows, k, rounds, 16)


def test_clustering_scans_few_vectors_again(spark):
    rows = [(i, 0, v) for i, (_, _, v) in enumerate(r for r in _vectors(4, 1500, d=16, spread=0.05) if _usable(r[2]))
            if len(v) == 16 and max(map(abs, v)) < 100]
    report = []
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], VECTOR)
    got = clustering.cluster(df, 6, 5, 16, report=report)
    assert Counter(map(tuple, got.collect())) == _clusters(rows, 6, 5, 16)
    assert report[0] == len(rows) and len(report) == 6 and report[-1] < len(rows) / 2
    assert clustering.cluster(df.limit(0)).columns == got.columns and clustering.cluster(df.limit(0)).count() == 0


def test_exact_products():
    big = np.array([[2**62, -2**63], [5, 7]], dtype=np.int64)
    assert squared_distances(big, big).tolist() == [
        [sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in big] for x in big]
    assert Rows(big).products(big[0]).tolist() == [2**124 + 2**126, 5 * 2**62 - 7 * 2**63]


def _dropped(rows, least, chars, keep_first):
    """Counts over all lines, and what is left of each text."""
    space = " \t\n\v\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = [[(x, x.strip(space).translate(lower)) for x in (t or "").split("\n")] for _, t in rows]
    counts, first = Counter(), {}
    for (doc, _), own in zip(rows, lines):
        counts.update({k for _, k in own if len(k) >= chars})
        for i, (_, k) in enumerate(own):
            here = (doc is not None, doc, i)
            first[k] = min(first.get(k, here), here)
    out = Counter()
    for (doc, _), own in zip(rows, lines):
        kept = [x for i, (x, k) in enumerate(own) if not (k and counts[k] >= least)
                or keep_first and first[k] == (doc is not None, doc, i)]
        out[doc, "\n".join(kept), len(own), len(own) - len(kept)] += 1
    return out


def _line_rows(fixture_rows):
    rng = random.Random(11)
    common = ["Subscribe", "  all rights reserved ", "ÄÖ Straße", "\t", "", "x", "漢字"] + [f"line {i}" for i in range(30)]
    rows = [(100 + i, "\n".join(rng.choice(common).upper() if rng.random() < 0.2 else rng.choice(common)
                                for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    rows += [(300, "same\n\nsame")] * 9 + [(301, "SAME\r\n"), (302, "same"), (400, "nine")] + [(None, "same\nline 3")]
    rows += [(500 + i, "nine ") for i in range(9)] + [(600 + i, "nine") for i in range(8)] + [(700, "nine\n" * 5)]
    rows += [(800, "\n".join(f"own {i}" for i in range(5000)))]
    return fixture_rows + rows


@pytest.mark.parametrize("least, chars, first, bits, most", [
    (10, 1, False, 1 << 30, 1 << 20), (10, 1, False, 64, 0), (2, 3, True, 1 << 12, 1 << 20), (2, 1, True, 1 << 30, 0),
    (10, 1, True, 1 << 30, 1 << 20)])
def test_line_dedup(spark, fixture_rows, least, chars, first, bits, most):
    rows = _line_rows(fixture_rows)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "a", "b", 1, b"c", 2) for r in rows],
                               "doc_id long, text string, part string, key string, n long, kept binary, line int")
    got = line_dedup.drop_repeated_lines(df.repartition(3), least, chars, first, max_bits=bits, max_broadcast=most)
    assert Counter(map(tuple, got.collect())) == _dropped(rows, least, chars, first)
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_filters_hold_every_repeat(spark):
    rows = [(f"a{i % 700}\nb{i}".encode(),) for i in range(1400)]
    df = spark.createDataFrame(rows, "text binary").repartition(4)
    found = line_dedup.seen_twice(df, 1 << 10).collect()
    bits = np.zeros(1 << 10, dtype=np.uint64)
    for r in found:
        bits[r.part * line_dedup.PART:][:len(r.bits) // 8] = np.frombuffer(r.bits, dtype=np.uint64)
    hashes = lambda keys: line_dedup._digests([k.encode() for k in keys])[:, 0]
    assert line_dedup.holds(bits, hashes([f"a{i}" for i in range(700)])).all()
    assert line_dedup.holds(bits, hashes([f"b{i}" for i in range(1400)])).mean() < 0.1
