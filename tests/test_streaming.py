"""Streams equal their batch twins, for rows that arrive late and out of order."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from replaylens.operators import asof, events
from replaylens.sources.state_log import good_updates, read_state_log, read_state_stream
from replaylens.streaming import frame_stream, state_stream

LINE = "session STRING, t DOUBLE, kind STRING, n BIGINT, health INT, dx INT, dy INT"


def state_column():
    return F.struct((F.col("health") > 0).alias("alive"), F.lit("live").alias("round_phase"), F.col("health"),
                    F.lit("rifle").alias("active_weapon"), F.lit(1).alias("ammo_clip"), F.lit(2).alias("ammo_reserve")).alias("state")


def recording():
    rng = np.random.default_rng(11)
    rows = []
    for s, start in (("a", 0.0), ("b", 3.0), ("late", 40.0), ("silent", None)):
        rows += [(s, round(i * 0.5 + 0.001, 6), "frame", i, None, None, None) for i in range(60)]
        rows += [(s, round(float(t), 6), "mouse", 1000 + i, None, int(rng.integers(-9, 10)), 1)
                 for i, t in enumerate(rng.uniform(0, 30, 90))]
        if start is not None:
            rows += [(s, round(start + i * 1.7, 6), "state", 2000 + i, int(rng.integers(0, 3)), None, None) for i in range(8)]
    return pd.DataFrame(rows, columns=["session", "t", "kind", "n", "health", "dx", "dy"])


def write(path, pdf, name):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        for r in pdf.to_dict("records"):
            f.write(json.dumps({k: (None if pd.isna(x) else int(x) if k in ("n", "health", "dx", "dy") else x) for k, x in r.items()}) + "\n")


def parts(df):
    def kind(k):
        return df.where(F.col("kind") == k)
    return (kind("frame").select("session", "t", "n"), kind("state").select("session", "t", "n", state_column()),
            kind("mouse").select("session", "t", "n", "dx", "dy"))


def run(df, tmp_path):
    q = (df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out")), q


@pytest.mark.parametrize("require", [True, False])
def test_recording_stream_equals_batch(spark, tmp_path, require):
    pdf = recording()
    shuffled = pdf.assign(at=pdf.t + np.random.default_rng(2).uniform(0, 8, len(pdf))).sort_values("at").drop(columns="at")
    for i, piece in enumerate(np.array_split(np.arange(len(shuffled)), 3)):
        write(str(tmp_path / "in"), shuffled.iloc[piece], f"{i}.json")
    write(str(tmp_path / "in"), pd.DataFrame([("end", 9999.0, "frame", -1, None, None, None)], columns=pdf.columns), "z.json")
    for i, name in enumerate(["0.json", "1.json", "2.json", "z.json"]):
        os.utime(tmp_path / "in" / name, (1000 + i, 1000 + i))
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = frame_stream.record_stream(frame_stream.recording_input(*parts(stream)), "10 seconds", chunk_frames=25, require_contact=require)
    got_df, _ = run(frame_stream.with_metrics(out), tmp_path)
    got = {(r["session"], r["n"]): r for r in got_df.where("session <> 'end'").collect()}

    frames, states, mouse = parts(spark.read.schema(LINE).json(str(tmp_path / "in")).where("session <> 'end'"))
    kept = asof.after_contact(frames, states) if require else frames
    joined = {(r["session"], r["n"]): r for r in asof.asof_state(kept, states).collect()}
    assert set(got) == set(joined)
    assert {s for s, _ in got} == ({"a", "b"} if require else {"a", "b", "late", "silent"})
    motion = {(r["session"], r["frame_idx"]): r for r in asof.accumulate_mouse(
        kept.withColumnRenamed("n", "frame_idx"), mouse.drop("n")).collect()}
    for key, r in got.items():
        want = joined[key]
        assert r["health"] == (want["state"]["health"] if want["state"] else 0)
        assert r["state_age"] == (pytest.approx(want["state_age"]) if want["state"] else None)
        assert (r["dx"], r["n_events"]) == (motion[key]["dx"], motion[key]["n_events"])
    for s in {s for s, _ in got}:
        rows = sorted((r for k, r in got.items() if k[0] == s), key=lambda r: r["t"])
        assert [r["frame_idx"] for r in rows] == list(range(len(rows)))
        assert all(r["chunk_idx"] == r["frame_idx"] // 25 for r in rows)
        assert rows[0]["gap"] is None and all(b["gap"] == pytest.approx(b["t"] - a["t"]) for a, b in zip(rows, rows[1:]))


def log_line(t, n, health, seen="me"):
    return json.dumps({"t_perf": t, "n": n, "payload": {
        "provider": {"steamid": "me"}, "player": {"steamid": seen, "state": {"health": health}}, "round": {"phase": "live"}}})


def test_change_stream_and_side_output(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    first = [log_line(1, 1, 100), log_line(2, 2, 40), "broken", log_line(3, 3, 0)]
    second = [log_line(4, 4, 100), log_line(5, 5, 80, seen="mate"), log_line(6, 6, 80, seen="mate")]
    (logs / "s1.jsonl").write_text("\n".join(first) + "\n")
    (logs / "s2.jsonl").write_text("\n".join([log_line(1, 1, 50)]) + "\n")
    updates = read_state_stream(spark, str(logs))
    changes = state_stream.change_stream(good_updates(updates))
    run(changes, tmp_path)
    os.makedirs(tmp_path / "more")
    (tmp_path / "more" / "s1.jsonl").write_text("\n".join(second) + "\n")
    os.rename(tmp_path / "more" / "s1.jsonl", logs / "s1_part2.jsonl")
    got, _ = run(state_stream.change_stream(good_updates(updates.withColumn(
        "session", F.regexp_replace("session", "_part2", "")))), tmp_path)
    rows = {(r["session"], r["n"]): (sorted(r["changed"]), r["death"], r["reason"]) for r in got.collect()}
    batch = good_updates(read_state_log(spark, str(logs))).withColumn("session", F.regexp_replace("session", "_part2", ""))
    want = {(r["session"], r["n"]): sorted(r["changed"]) for r in events.change_events(batch).collect()}
    assert {k: x[0] for k, x in rows.items()} == want
    assert rows["s1", 3][1:] == (True, "health 0") and rows["s1", 5][1:] == (True, "spectating")
    assert ("s1", 6) not in rows
    deaths = [(r["n"], r["reason"]) for r in events.death_events(batch).orderBy("n").collect()]
    assert deaths == [(3, "health 0"), (5, "spectating")]

    q = (state_stream.split_sinks(updates, str(tmp_path / "good"), str(tmp_path / "bad"))
         .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 7
    assert [r["bad_line"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["broken"]


def test_latest_state_stream_and_chunks(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "s.jsonl").write_text("\n".join(log_line(i, i, i) for i in range(5)) + "\n")
    stream = state_stream.latest_state(good_updates(read_state_stream(spark, str(logs))))
    q = stream.writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.table("latest").first()
    assert (row["state"]["health"], row["n_updates"]) == (4, 5)

    write(str(tmp_path / "in"), pd.DataFrame([("s", i * 1.0, "frame", i, None, None, None) for i in range(7)]
                                             + [("s", 9e4, "frame", 99, None, None, None)],
                                             columns=["session", "t", "kind", "n", "health", "dx", "dy"]), "0.json")
    source = spark.readStream.schema(LINE).json(str(tmp_path / "in"))
    out = frame_stream.record_stream(frame_stream.recording_input(*parts(source)), "1 second", chunk_frames=3, require_contact=False)
    q = (frame_stream.write_chunks(out, str(tmp_path / "chunks")).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "chunks"))
    assert sorted((r["frame_idx"], r["chunk_idx"]) for r in got.collect()) == [(i, i // 3) for i in range(7)]


def test_rows_behind_the_release_go_aside(spark, tmp_path):
    """Late rows are named, take no part, and leave the other frames as they are without them."""
    pdf = recording()
    pdf = pdf[pdf.session.isin(["a", "b"])]
    late = pdf[(pdf.n % 11 == 3) & (pdf.t < 15)]
    prompt = pdf.drop(late.index)
    steps = [prompt[prompt.t < 10], prompt[prompt.t >= 10], late[late.t < 12]]
    steps.append(pd.concat([late[late.t >= 12], pd.DataFrame([("end", 90.0, "frame", -1, None, None, None)], columns=pdf.columns)]))
    steps.append(pd.DataFrame([("end", 9999.0, "frame", -2, None, None, None)], columns=pdf.columns))
    for i, piece in enumerate(steps):
        write(str(tmp_path / "in"), piece, f"{i}.json")
        os.utime(tmp_path / "in" / f"{i}.json", (1000 + i, 1000 + i))
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = frame_stream.record_stream(frame_stream.recording_input(*parts(stream)), "5 seconds", require_contact=False,
                                     slice_seconds=0.7, late_for="10 minutes")
    got, _ = run(out, tmp_path)
    got = got.where("session <> 'end'")
    assert {(r["session"], r["n"], r["kind"]) for r in frame_stream.late_rows(got).collect()} == {
        (r.session, r.n, r.kind) for r in late.itertuples()}
    write(str(tmp_path / "prompt"), prompt, "0.json")
    frames, states, _ = parts(spark.read.schema(LINE).json(str(tmp_path / "prompt")))
    want = {(r["session"], r["n"]): r for r in asof.asof_state(frames, states).collect()}
    rows = frame_stream.on_time(got).collect()
    assert len(rows) == len(want)
    for r in rows:
        state = want[r["session"], r["n"]]["state"]
        assert r["health"] == (state["health"] if state else 0)
    for s in ("a", "b"):
        order = sorted((r for r in rows if r["session"] == s), key=lambda r: r["t"])
        assert [r["frame_idx"] for r in order] == list(range(len(order)))


def test_slots_survive_a_restart(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()

    def step(name, lines):
        (logs / name).write_text("\n".join(lines) + "\n")
        slots = state_stream.slot_stream(good_updates(read_state_stream(spark, str(logs)).withColumn(
            "session", F.substring("session", 1, 1))))
        q = (slots.writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return {r["session"]: (r["n"], r["n_updates"], r["health"], r["alive"]) for r in
                state_stream.read_slots(spark, str(tmp_path / "cp")).collect()}
    assert step("a1.jsonl", [log_line(2, 2, 40), log_line(1, 1, 90), "broken"]) == {"a": (2, 2, 40, True)}
    assert step("b1.jsonl", [log_line(5, 5, 0)]) == {"a": (2, 2, 40, True), "b": (5, 1, 0, False)}
    assert step("a2.jsonl", [log_line(3, 3, None)]) == {"a": (3, 3, None, None), "b": (5, 1, 0, False)}
