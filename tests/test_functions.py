"""Column functions, splits and state extraction against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from replaylens.functions import actions, numeric, state
from replaylens.functions.geometry import geometry_columns
from replaylens.operators import split
from replaylens.operators.frames import exclusions, gameplay
from replaylens.operators.validate import checked_features, not_finite, not_served_once
from replaylens.sources.state_log import bad_lines, good_updates, parse_lines, read_state_log, update_quality


def names(spark, values, n=10):
    return spark.createDataFrame([(x, n) for x in values], "session STRING, n_frames LONG")


def sides(df):
    return {r["session"]: r["side"] for r in df.collect()}


def test_hash_split_is_stable_and_exact(spark):
    six = [f"session_{i}" for i in range(6)]
    twelve = six + [f"later_{i}" for i in range(6)]
    first, second = sides(split.split_sessions(names(spark, six))), sides(split.split_sessions(names(spark, twelve)))
    assert all(second[k] == x for k, x in first.items())
    for r in split.split_sessions(names(spark, twelve), 0.4).collect():
        digest = hashlib.blake2b(r["session"].encode(), digest_size=8).digest()
        bucket = int.from_bytes(digest, "big") % 1000
        assert r["bucket"] == bucket and r["side"] == ("holdout" if bucket < 400 else "train")


def test_manual_holdout_forces_only_named_sessions(spark):
    base = sides(split.split_sessions(names(spark, "abcdef")))
    forced = sides(split.split_sessions(names(spark, "abcdef"), manual=["a"]))
    assert forced["a"] == "holdout" and all(forced[k] == base[k] for k in "bcdef")


@pytest.mark.parametrize("sizes, fraction, want", [
    ({"a": 100, "b": 10, "c": 10}, 0.4, {"a": "train", "b": "holdout", "c": "holdout"}),
    ({"a": 5, "b": 5}, 0.0, {"a": "train", "b": "holdout"}),      # smallest moves to holdout
    ({"a": 9, "b": 5}, 1.0, {"a": "train", "b": "holdout"}),      # largest moves to train
    ({"a": 7}, 0.4, {"a": "train"}),
    ({"a": 0, "b": 0}, 0.4, {}),
])
def test_balanced_split(spark, sizes, fraction, want):
    df = spark.createDataFrame(list(sizes.items()), "session STRING, n_frames LONG")
    assert sides(split.balanced_split(df, fraction)) == want


def test_split_report_shows_empty_sides(spark):
    rows = {r["side"]: r for r in split.split_report(split.split_sessions(names(spark, ["x"]), 0.0)).collect()}
    assert rows["holdout"]["n_sessions"] == 0 and rows["holdout"]["note"] == "holdout is empty"


def payload(own="me", seen="me", **player):
    body = {"auth": {"token": "t"}}
    if own:
        body["provider"] = {"steamid": own}
    body["player"] = ({"steamid": seen} if seen else {}) | player
    return body


CASES = [
    (payload(state={"health": 100}, observer_slot=5), dict(alive=True, own_pov=True, health=100, has_local_state=True)),
    (payload(state={"health": 0}), dict(alive=False, health=0)),
    (payload(seen="mate", state={"health": 100}), dict(alive=False, spectating=True, own_pov=False)),
    (payload(own=None, state={"health": 50}), dict(alive=True, own_pov=True, steamid=None)),
    (payload(), dict(alive=None, has_local_state=False, health=None)),
    (payload(state={}), dict(alive=None, has_local_state=False)),
    (payload(state={"armor": 3}), dict(alive=None, has_local_state=True, health=None)),
    (payload(weapons={"weapon_0": {"name": "knife", "state": "active"}}),
     dict(active_weapon="knife", ammo_clip=None, ammo_reserve=None)),
    (payload(weapons={"weapon_0": {"name": "knife", "state": "holstered"},
                      "weapon_1": {"name": "rifle", "state": "active", "ammo_clip": 0, "ammo_reserve": 90}}),
     dict(active_weapon="rifle", ammo_clip=0, ammo_reserve=90)),
]


def test_state_extraction_and_storage(spark):
    lines = [("s", json.dumps({"t_perf": float(i), "t_wall": "w", "n": i, "payload": p})) for i, (p, _) in enumerate(CASES)]
    df = parse_lines(spark.createDataFrame(lines, "session STRING, value STRING"))
    got = {r["n"]: r for r in df.collect()}
    for i, (_, want) in enumerate(CASES):
        assert {k: got[i]["state"][k] for k in want} == want, i
    stored = {r["n"]: r for r in df.select("n", *state.stored_state()).collect()}
    assert (stored[4]["alive"], stored[4]["round_phase"], stored[4]["health"], stored[4]["ammo_clip"]) == (0, "?", 0, -1)
    assert stored[7]["ammo_clip"] == -1 and stored[8]["ammo_clip"] == 0
    long = spark.createDataFrame([("x" * 30, "y" * 30)], "p STRING, w STRING").select(F.struct(
        F.lit(None).cast("boolean").alias("alive"), F.col("p").alias("round_phase"), F.lit(None).cast("int").alias("health"),
        F.col("w").alias("active_weapon"), F.lit(1).alias("ammo_clip"), F.lit(2).alias("ammo_reserve")).alias("state"))
    row = long.select(*state.stored_state()).first()
    assert len(row["round_phase"]) == 16 and len(row["active_weapon"]) == 24


def test_log_files_bad_lines_and_tokens(spark, tmp_path):
    good = json.dumps({"t_perf": 1.0, "n": 1, "payload": {"auth": {"token": "wrong"}, "player": {"state": {"health": 5}}}})
    (tmp_path / "gsi_1.jsonl").write_text(good + "\nnot json\n" + json.dumps({"t_perf": 2.0, "n": 2, "payload": {}}) + "\n")
    df = read_state_log(spark, str(tmp_path), expected_token="right")
    assert update_quality(df).first().asDict() == {"session": "gsi_1", "n_updates": 2, "n_bad": 1, "n_token_mismatch": 1}
    assert [r["bad_line"] for r in bad_lines(df).collect()] == ["not json"]
    assert good_updates(df).where("n = 1").first()["state"]["health"] == 5


def test_readouts(spark):
    df = spark.createDataFrame([([1, 0, 1], ["w", "a", "d"], 1, 0, 3, -1), ([0, 0, 0], ["w", "a", "d"], 0, 0, 0, 0)],
                               "keys ARRAY<TINYINT>, key_names ARRAY<STRING>, lclick INT, rclick INT, dx INT, dy INT")
    assert [r[0] for r in df.select(actions.action_text()).collect()] == [
        "keys[w+d]  click[L]  mouse(dx=+3, dy=-1)", "keys[-]  click[-]  mouse(dx=+0, dy=+0)"]
    schema = "alive INT, round_phase STRING, health INT, active_weapon STRING, ammo_clip INT, ammo_reserve INT"
    rows = spark.createDataFrame([(1, "live", 7, "rifle", 3, 90), (0, "over", 0, "", -1, -1), (1, "live", None, None, None, None),
                                  (None,) * 6], schema)
    assert [r[0] for r in rows.select(state.state_text()).collect()] == [
        "GSI: ALIVE  round[live]  hp=  7  wpn[rifle]  ammo[3/90]", "GSI: dead  round[over]  hp=  0  wpn[-]  ammo[-]",
        "GSI: ALIVE  round[live]", None]
    assert [r[0] for r in rows.select(state.life_label()).collect()] == ["ALIVE", "dead / spectating", "ALIVE", None]


def test_missing_key_is_an_error(spark):
    df = spark.createDataFrame([([1], ["w"])], "keys ARRAY<TINYINT>, key_names ARRAY<STRING>")
    assert df.select(actions.key_held("w")).first()[0] == 1
    with pytest.raises(Exception, match="'q' is not logged"):
        df.select(actions.key_held("q")).collect()


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (-800.0, -2.5, -0.5, 0.5, 1.5, 2.5, 700.0)], "x DOUBLE")
    assert [r[0] for r in df.select(actions.mouse_step(F.col("x"))).collect()] == [-600, -2, 0, 0, 2, 2, 600]
    s = [r[0] for r in df.select(numeric.sigmoid(F.col("x"))).collect()]
    assert s[0] == 0.0 and s[-1] == 1.0 and s[3] == pytest.approx(0.6224593312)
    logs = spark.createDataFrame([(float("nan"),), (float("inf"),), (-4.0,), (99.0,)], "v DOUBLE").select(
        numeric.log_variance(F.col("v"))).collect()
    assert [r[0] for r in logs] == [None, None, 0.0, 2.0]
    pressed = spark.createDataFrame([([0.5, 0.4, 0.39],)], "p ARRAY<DOUBLE>").select(
        actions.pressed_keys("p", ["w", "a", "s"], 0.4)).first()[0]
    assert pressed == ["w", "a"]


def test_geometry(spark):
    stamp = "fullscreen 1920x1080 -> crop L0T0W1920H1080 -> FPV 270x150 BGR; radar src L10T10W260H260 -> 128x128 BGR"
    row = spark.createDataFrame([(stamp,), ("synthetic",)], "geom STRING").select(*geometry_columns()).collect()
    assert (row[0]["fpv_w"], row[0]["radar_w"], row[0]["colour"]) == (270, 260, "BGR") and row[1]["fpv_w"] is None


def test_filters_and_their_account(spark):
    rows = [("s", 0, 0, "freezetime", True), ("s", 1, 1, "freezetime", True), ("s", 2, 1, "?", False),
            ("s", 3, 1, "live", None), ("s", 4, None, None, True)]
    df = spark.createDataFrame(rows, "session STRING, frame_idx INT, alive INT, round_phase STRING, keep BOOLEAN")
    served = {(g, m): [r[0] for r in gameplay(df, g, m).select("frame_idx").collect()] for g in (0, 1) for m in (0, 1)}
    assert served == {(0, 0): [0, 1, 2, 3, 4], (0, 1): [0, 1, 3, 4], (1, 0): [2, 3, 4], (1, 1): [3, 4]}
    assert exclusions(df).first().asDict() == {"session": "s", "n_frames": 5, "n_masked_alive": 1, "n_masked_freeze": 1,
                                               "n_masked_keep": 1, "n_served": 2}


def test_guards(spark):
    ask = spark.createDataFrame([("s", i) for i in range(4)], "session STRING, frame_idx INT")
    got = ask.where("frame_idx <> 2").unionByName(ask.where("frame_idx = 1"))
    assert sorted(r["frame_idx"] for r in not_served_once(ask, got, ["session", "frame_idx"]).collect()) == [1, 2]
    feats = spark.createDataFrame([([1.0, 2.0],), ([float("nan")],)], "features ARRAY<DOUBLE>")
    assert not_finite(feats).count() == 1
    with pytest.raises(Exception, match="non-finite"):
        checked_features(feats).collect()
