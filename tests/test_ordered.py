"""Block-wise operators against brute force, with blocks so small that every edge is crossed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from replaylens.operators import asof, events, frames as fr, ordered, timing, windows


@pytest.fixture(scope="module")
def hot(spark):
    """One session holds most rows; some frames are dropped."""
    rng = np.random.default_rng(5)
    rows = []
    for name, n in (("hot", 700), ("b", 40), ("c", 1)):
        t = np.cumsum(rng.uniform(0.04, 0.2, n))
        for i in range(n):
            rows.append((name, i, float(t[i]), i // 60, int(rng.integers(-5, 6)), bool(rng.random() < 0.8)))
    pdf = pd.DataFrame(rows, columns=["session", "frame_idx", "t", "chunk_idx", "dx", "keep"])
    return pdf, spark.createDataFrame(pdf).repartition(5)


def brute_windows(pdf, length):
    out, stats = [], {}
    for s, g in pdf.groupby("session"):
        kept = sorted(g[g.keep].frame_idx)
        runs = np.split(kept, np.nonzero(np.diff(kept) != 1)[0] + 1) if len(kept) else []
        stats[s] = (len(runs), sum(len(r) < length for r in runs))
        for r in runs:
            out += [(s, int(r[i]), int(r[i + length - 1])) for i in range(len(r) - length + 1)]
    return sorted(out), stats


@pytest.mark.parametrize("length", [1, 3, 8])
@pytest.mark.parametrize("rows", [9, 64, 65536])
def test_windows_do_not_depend_on_blocks(hot, length, rows):
    pdf, df = hot
    kept = df.where("keep")
    want, stats = brute_windows(pdf, length)
    got = windows.sliding_windows(kept, length, gather=["dx"], rows=rows).collect()
    assert sorted((r["session"], r["first_idx"], r["last_idx"]) for r in got) == want
    dx = {(r.session, r.frame_idx): r.dx for r in pdf.itertuples()}
    assert all(list(r["w_dx"]) == [dx[r["session"], i] for i in range(r["first_idx"], r["last_idx"] + 1)] for r in got)
    s = {r["session"]: (r["runs"], r["runs_too_short"]) for r in windows.window_stats(kept, length, rows).collect()}
    assert s == {k: x for k, x in stats.items() if x[0]}
    run_rows = windows.runs(kept, rows, rows).collect()
    assert all(r["run_end"] - r["run_start"] + 1 == r["run_length"] for r in run_rows)
    assert len(run_rows) == sum(x[0] for x in stats.values())


def test_window_length_must_be_positive(hot):
    with pytest.raises(ValueError):
        windows.sliding_windows(hot[1], 0)
    with pytest.raises(ValueError):
        windows.sliding_windows(hot[1], 8, rows=8)


@pytest.mark.parametrize("rows", [7, 65536])
def test_gaps(hot, rows):
    pdf, df = hot
    got = {(r["session"], r["frame_idx"]): (r["gap"], r["at_boundary"]) for r in timing.gaps(df, rows).collect()}
    want = {}
    for s, g in pdf.groupby("session"):
        t, c = g.t.to_numpy(), g.chunk_idx.to_numpy()
        want.update({(s, i): (t[i + 1] - t[i], c[i + 1] != c[i]) for i in range(len(t) - 1)})
    assert got == want


@pytest.mark.parametrize("rows", [11, 65536])
def test_neighbours_and_switch(hot, rows):
    pdf, df = hot
    got = {(r["session"], r["frame_idx"]): r for r in events.neighbours_in_state(df, rows).collect()}
    for s, g in pdf.groupby("session"):
        keep = g.sort_values("frame_idx").keep.to_numpy()
        for i in range(len(keep)):
            for name, state in (("kept", True), ("dropped", False)):
                later = np.nonzero(keep[i + 1:] == state)[0]
                before = np.nonzero(keep[:i] == state)[0]
                assert got[s, i][f"next_{name}"] == (i + 1 + later[0] if len(later) else i)
                assert got[s, i][f"prev_{name}"] == (before[-1] if len(before) else i)
    for r in events.switch_point(df, rows).collect():
        dx = pdf[pdf.session == r["session"]].sort_values("frame_idx").dx.to_numpy()
        scores = [(dx[:k] > 0).sum() + (dx[k:] < 0).sum() for k in range(1, len(dx))]
        if scores:
            assert (r["best_k"], r["best_score"]) == (int(np.argmax(scores)) + 1, max(scores))
        else:
            assert r["best_k"] is None


@pytest.mark.parametrize("seconds", [0.5, None])
def test_asof_and_mouse(spark, hot, seconds, monkeypatch):
    monkeypatch.setattr(ordered, "TIME_BLOCK_ROWS", 50)
    pdf, df = hot
    rng = np.random.default_rng(1)
    states = pd.DataFrame([("hot", float(t), i, f"s{i}") for i, t in enumerate(sorted(rng.uniform(20, 70, 60)))]
                          + [("b", 1.0, 0, "only")], columns=["session", "t", "n", "state"])
    tie = pdf[(pdf.session == "hot") & (pdf.frame_idx == 400)].t.iloc[0]
    states.loc[len(states)] = ["hot", tie, 1000, "tie"]
    out = asof.asof_state(df, spark.createDataFrame(states), seconds).collect()
    assert len(out) == len(pdf)
    for r in out:
        past = states[(states.session == r["session"]) & (states.t <= r["t"])].sort_values(["t", "n"])
        assert r["state"] == (past.state.iloc[-1] if len(past) else None)
        assert r["state_age"] == (pytest.approx(r["t"] - past.t.iloc[-1]) if len(past) else None)
    mouse = pd.DataFrame([("hot", float(t), int(x), 1) for t, x in zip(rng.uniform(0, 200, 500), rng.integers(-9, 9, 500))],
                         columns=["session", "t", "dx", "dy"])
    got = {(r["session"], r["frame_idx"]): (r["dx"], r["n_events"]) for r in asof.accumulate_mouse(
        df.select("session", "t", "frame_idx"), spark.createDataFrame(mouse), seconds).collect()}
    for s, g in pdf.groupby("session"):
        t = g.sort_values("frame_idx").t.to_numpy()
        for i in range(len(t)):
            lo = t[i - 1] if i else -np.inf
            m = mouse[(mouse.session == s) & (mouse.t > lo) & (mouse.t <= t[i])]
            assert got[s, i] == (m.dx.sum(), len(m))


def test_contact(spark):
    frames = spark.createDataFrame([(s, float(t)) for s in "abc" for t in range(0, 40, 2)], "session STRING, t DOUBLE")
    states = spark.createDataFrame([("a", 5.0), ("a", 9.0), ("b", 30.0)], "session STRING, t DOUBLE")
    report = {r["session"]: r["contacted"] for r in asof.contact_report(frames, states).collect()}
    assert report == {"a": True, "b": False, "c": False}
    strict = asof.after_contact(frames, states)
    assert {r["session"] for r in strict.collect()} == {"a"} and strict.agg(F.min("t")).first()[0] == 6.0
    waived = asof.after_contact(frames, states, require=False).groupBy("session").count()
    assert {r["session"]: r["count"] for r in waived.collect()} == {"a": 17, "b": 20, "c": 20}


@pytest.mark.parametrize("block_rows", [10, 1 << 20])
def test_numbering_and_totals(spark, hot, block_rows, monkeypatch):
    monkeypatch.setattr(ordered, "TIME_BLOCK_ROWS", block_rows)
    pdf, df = hot
    got = ordered.number_rows(df.drop("frame_idx").withColumnRenamed("chunk_idx", "c"), ["session"], ["t"], "t")
    want = {(r.session, r.t): r.frame_idx for r in pdf.itertuples()}
    assert {(r["session"], r["t"]): r["frame_idx"] for r in got.collect()} == want
    total = ordered.running_total(df.withColumn("k", F.struct("session", "frame_idx")), "k", "dx", "before", blocks=16).collect()
    seen = 0
    for r in sorted(total, key=lambda r: (r["session"], r["frame_idx"])):
        assert r["before"] == seen
        seen += r["dx"]
    lengths = df.groupBy("session").agg(F.count("*").alias("n_frames"))
    ids = sorted(r["global_idx"] for r in fr.with_global_index(df, lengths).collect())
    assert ids == list(range(len(pdf)))


def test_order_statistics_with_hot_values(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.full(3000, 7.25), rng.normal(0, 1e6, 500), -rng.exponential(1e-4, 500), [0.0]])
    pdf = pd.DataFrame({"g": ["x"] * len(values), "v": values})
    n = F.col("n")
    row = ordered.order_statistics(spark.createDataFrame(pdf), ["g"], "v", {
        "lo": F.lit(0), "q": F.floor(n * 0.2), "mid": F.floor(n / 2), "hi": n - 1}).first()
    s = np.sort(values)
    k = len(s)
    assert (row["lo"], row["q"], row["mid"], row["hi"]) == (s[0], s[int(k * 0.2)], s[k // 2], s[-1])


def test_batches(spark, hot):
    pdf, df = hot
    out = fr.batches(df, "frame_idx", 50, seed=3).collect()
    again = fr.batches(df.repartition(3), "frame_idx", 50, seed=3).collect()
    def place(rows):
        return {(r["session"], r["frame_idx"]): (r["batch_id"], r["place"]) for r in rows}
    assert place(out) == place(again) and len(set(place(out).values())) == len(pdf)
    assert {r["batch_id"] for r in fr.batches(df, "frame_idx", 50, 3, drop_last=True).collect()} == set(range(len(pdf) // 50))
    other = place(fr.batches(df, "frame_idx", 50, seed=4).collect())
    assert other != place(out)


def test_stride_and_dropped_samples(spark, hot):
    pdf, df = hot
    rows = df.withColumnRenamed("frame_idx", "last_idx")
    got = sorted((r["session"], r["last_idx"]) for r in fr.stride_sample(rows, 37, block_rows=16).collect())
    order = sorted((r.session, r.frame_idx) for r in pdf.itertuples())
    want = [order[i] for i in np.unique(np.linspace(0, len(order) - 1, 37).astype(int))]
    assert got == sorted(want)
    dropped = fr.even_sample_where(df, ~F.col("keep"), 5, rows=16).where("session = 'hot'").collect()
    idx = np.array(sorted(pdf[(pdf.session == "hot") & ~pdf.keep].frame_idx))
    assert sorted(r["frame_idx"] for r in dropped) == idx[np.linspace(0, len(idx) - 1, 5).astype(int)].tolist()


def test_previous_row_across_blocks(spark, hot):
    pdf, df = hot
    kept = df.where("keep")
    out = ordered.with_previous(kept, ["session"], ["frame_idx"], ordered.index_block("frame_idx", 13), ["frame_idx"],
                                seen={"had_big": F.col("dx") == 5}).collect()
    for s, g in pdf[pdf.keep].groupby("session"):
        g = g.sort_values("frame_idx")
        idx, big = g.frame_idx.tolist(), (g.dx == 5).tolist()
        rows = {r["frame_idx"]: r for r in out if r["session"] == s}
        for j, i in enumerate(idx):
            assert (rows[i]["prev"]["frame_idx"] if rows[i]["prev"] else None) == (idx[j - 1] if j else None)
            assert rows[i]["had_big"] == any(big[:j])


def test_key_edges_across_blocks(spark):
    held = [[], ["w"], ["w", "a"], ["a", "x"], [], ["d"], ["d"]]
    df = spark.createDataFrame([("s", i * 3, h) for i, h in enumerate(held)], "session STRING, frame_idx LONG, held ARRAY<STRING>")
    got = sorted((r["frame_idx"], r["event"], r["key"]) for r in events.key_edges(df, ["w", "a", "d"], rows=4).collect())
    assert got == [(3, "press", "w"), (6, "press", "a"), (9, "release", "w"), (12, "release", "a"), (15, "press", "d"),
                   (18, "release_all", "d")]


def test_order_statistics_of_nearly_constant_values(spark):
    """Values that share one cell: the sorted part is a small share of them."""
    values = [66.7 + i * 1e-6 for i in range(5000)] + [66.7] * 40 + [1.0, 9e9]
    df = spark.createDataFrame([("s", float(x)) for x in values], "session string, x double")
    got = ordered.order_statistics(df, ["session"], "x", {"mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1}).first()
    assert (got.n, got.mid, got.last) == (len(values), sorted(values)[len(values) // 2], 9e9)
    cells = df.select(F.lit("mid").alias("name"), F.col("x").alias("_v"), F.lit(1).alias("_c"), F.lit(0).alias("_off"),
                      F.lit(2500).alias("rank")).where("_v between 60 and 70")
    assert ordered._narrowed(cells, ["name"]).count() <= 100


@pytest.mark.parametrize("shape", ["steady", "outlier", "pauses"])
def test_blocks_by_quantiles(spark, shape):
    """A clock that jumps once, or long pauses, leave no block with more than twice the mean."""
    rng = np.random.default_rng(8)
    t = np.cumsum(rng.exponential(1.0, 40_000))
    if shape == "outlier":
        t[-1] = 1e12
    if shape == "pauses":
        t += np.cumsum(np.where(np.arange(len(t)) % 9_000 == 0, 1e7, 0)) + np.where(np.arange(len(t)) > 30_000, t * 50, 0)
    pdf = pd.DataFrame({"session": ["hot"] * len(t) + ["b"] * 500, "t": np.concatenate([t, np.arange(500.0)])})
    out = ordered.add_block(spark.createDataFrame(pdf).repartition(4), ["session"], "t", 2_000)
    sizes = out.where("session = 'hot'").groupBy(ordered.BLOCK).agg(F.count("*").alias("n"), F.min("t").alias("lo"),
                                                                   F.max("t").alias("hi")).orderBy("lo").collect()
    assert [r[ordered.BLOCK] for r in sizes] == list(range(len(sizes)))  # in order, none empty
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
    assert 15 <= len(sizes) <= 26 and max(r["n"] for r in sizes) <= 2 * len(t) / len(sizes)
    assert {(r[ordered.BLOCK], r["_long"]) for r in out.where("session = 'b'").collect()} == {(0, False)}


def test_search_among_splitters(spark):
    for n in (1, 2, 3, 7, 8, 100):
        df = spark.range(-1, n + 2).select(F.lit("s").alias("session"), F.col("id").cast("double").alias("t"))
        cut = spark.createDataFrame([("s", [float(i) for i in range(n)])], "session string, _splits array<double>")
        leaps = F.expr("transform(sequence(cast(floor(log2(size(_splits))) as int), 0, -1), i -> cast(pow(2, i) as int))")
        got = df.join(cut.withColumn("_leaps", leaps), "session").select("t", ordered.reached("_splits", "_leaps", F.col("t")))
        assert all(k == min(max(t, 0), n) for t, k in got.collect())


def test_rank_cells_with_many_values(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SORTED_AT_ONCE", 10)
    values = [66.7 + i * 1e-6 for i in range(900)] + [1.0, 9e9]
    df = spark.createDataFrame([("s", float(x)) for x in values], "session string, x double")
    got = ordered.order_statistics(df, ["session"], "x", {"mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1}).first()
    assert (got.n, got.mid, got.last) == (len(values), sorted(values)[len(values) // 2], 9e9)
