"""Session-shaped views of the driver tables, once for Spark and once as DuckDB SQL.

Users are sessions and their events are frames; a part of the events serves as
state updates and as mouse increments. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replaylens.fixed_values import KEY_NAMES
from replaylens.operators.ordered import number_rows
from replaylens.session import written
from replaylens.sources.state_log import parse_lines

TOKEN = "good"

# One rule per logged key, valid in both engines.
KEY_RULES = {
    "w": "k % 10 < 6", "a": "k % 7 = 0", "s": "k % 11 = 0", "d": "k % 5 = 0", "space": "k % 13 = 0",
    "ctrl": "k % 19 = 0", "shift": "k % 3 = 0", "1": "k = 1", "2": "k = 2", "3": "k = 3", "r": "k % 23 = 0",
}
assert list(KEY_RULES) == KEY_NAMES

_COMMON = """
    case when event_type = 'click' then 1 else 0 end as lclick,
    case when k % 8 = 0 then 1 else 0 end as rclick,
    cast(floor(value) as int) - 50 as dx,
    k - 50 as dy,
    case when event_type <> 'error' then 1 else 0 end as alive,
    case event_type when 'signup' then 'freezetime' when 'error' then 'over'
                    when 'purchase' then '?' else 'live' end as round_phase,
    k as health,
    case when k % 12 = 0 then '' else event_type end as active_weapon,
    case when k % 9 = 0 then -1 else k % 31 end as ammo_clip,
    case when k % 9 = 0 then -1 else k end as ammo_reserve,
    value as variance,
    case when user_id % 5 = 0 then null else k % 4 <> 0 end as keep
"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with session, time in seconds and the number inside ``props``."""
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session"), "user_id", "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type", "value")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """All events as frames, indexed per session in time order."""
    indexed = number_rows(events(spark, d), ["session"], ["t", "event_id"], "t")
    return _columns(indexed)


def _columns(df: DataFrame) -> DataFrame:
    keys = F.array(*[F.expr(f"cast({rule} as tinyint)") for rule in KEY_RULES.values()])
    parts = [p.strip() for p in _COMMON.strip().split(",\n")]
    return (df.selectExpr("session", "user_id", "event_id", "t", "k", "event_type", "frame_idx",
                          "cast(floor(frame_idx / 20) as int) as chunk_idx", *parts)
            .withColumn("keys", keys).withColumn("key_names", F.array(*[F.lit(k) for k in KEY_NAMES])))


STATE_TYPES = ["error", "purchase"]


def is_state() -> Column:
    return F.col("event_type").isin(STATE_TYPES)


def plain_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events that are not state updates, as bare frames."""
    return events(spark, d).where(~is_state()).select(
        "session", "t", F.col("event_id").alias("frame_idx"), F.col("event_id").alias("n"))


def mouse_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where(is_state()).select(
        "session", "t", F.col("event_id").alias("n"),
        (F.floor("value").cast("int") - 50).alias("dx"), (F.col("k") - 50).alias("dy"))


def state_lines(spark: SparkSession, d: str) -> DataFrame:
    """State updates as the JSON text a receiver would log (session, value)."""
    def absent(cond: str, value: Column) -> Column:
        return F.when(~F.expr(cond), value)
    steamid = F.concat(F.lit("u"), F.col("session"))
    state = F.when(F.expr("k % 13 = 0"), F.struct(F.lit(None).cast("int").alias("health"))).otherwise(
        F.struct(F.when(F.col("event_type") == "error", 0).otherwise(F.col("k")).alias("health")))
    weapon = F.struct(F.concat(F.lit("weapon_"), (F.col("k") % 5).cast("string")).alias("name"),
                      F.lit("active").alias("state"), absent("k % 9 = 0", F.col("k") % 31).alias("ammo_clip"),
                      absent("k % 9 = 0", F.col("k")).alias("ammo_reserve"))
    holstered = F.struct(F.lit("weapon_knife").alias("name"), F.lit("holstered").alias("state"),
                         F.lit(None).cast("int").alias("ammo_clip"), F.lit(None).cast("int").alias("ammo_reserve"))
    payload = F.struct(
        F.struct(steamid.alias("steamid")).alias("provider"),
        F.struct(F.when(F.expr("k % 6 = 0"), "other").when(F.expr("k % 7 = 0"), None).otherwise(steamid).alias("steamid"),
                 F.lit("playing").alias("activity"), (F.col("k") % 10).alias("observer_slot"),
                 absent("k % 11 = 0", state).alias("state"),
                 absent("k % 8 = 0", F.struct(holstered.alias("weapon_0"), weapon.alias("weapon_1"))).alias("weapons"),
                 ).alias("player"),
        F.struct(F.when(F.expr("k % 4 = 0"), "freezetime").when(F.expr("k % 3 = 0"), None).otherwise("live").alias("phase")).alias("round"),
        F.struct(F.when(F.expr("k < 10"), "warmup").otherwise("live").alias("phase")).alias("map"),
        F.struct(F.when(F.expr("k % 10 = 0"), "bad").otherwise(TOKEN).alias("token")).alias("auth"))
    line = F.to_json(F.struct(F.col("t").alias("t_perf"), F.col("event_id").alias("n"), payload.alias("payload")))
    # Some receivers log a slot as text, or an empty list where there is no round.
    line = F.when(F.expr("k % 23 = 0"), F.regexp_replace(line, r'"observer_slot":\d+', '"observer_slot":"x"')).otherwise(line)
    line = F.when(F.expr("k % 29 = 0"), F.regexp_replace(line, r'"round":\{[^}]*\}', '"round":[]')).otherwise(line)
    bad = F.concat(F.lit("not json "), F.col("event_id").cast("string"))
    return events(spark, d).where(is_state()).select(
        "session", F.when(F.expr("k % 17 = 0"), bad).otherwise(line).alias("value"))


def updates(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(state_lines(spark, d), TOKEN)


def states(spark: SparkSession, d: str) -> DataFrame:
    """Good state updates: (session, t, n, state), parsed once into a table."""
    return written(updates(spark, d).where("bad_line IS NULL").select("session", "t", "n", "state"), "states")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as session manifests: pending ones are crashed, line items are chunks."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("items"))
    n = F.coalesce("items", F.lit(0))
    return (table(spark, d, "orders").join(items, "o_orderkey", "left").select(
        F.col("o_orderkey").cast("string").alias("session"),
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.lit(True).alias("is_folder"), F.col("o_orderdate").alias("modified"),
        F.array_repeat(F.lit("chunk"), n.cast("int")).alias("chunks"),
        F.when(F.expr("o_orderkey % 4 <> 0"), n + F.expr("case when o_orderkey % 10 = 0 then 1 else 0 end")).alias("total_frames"),
        (F.col("o_orderstatus") != "P").alias("complete"), F.lit(True).alias("readable"), n.alias("n_frames")))


def variance(spark: SparkSession, d: str) -> DataFrame:
    """Document lengths stand in for image variance: they span several decades."""
    return table(spark, d, "documents").select(
        (F.col("doc_id") % 40).cast("string").alias("session"), F.floor(F.col("doc_id") / 40).alias("frame_idx"),
        F.col("n_chars").cast("double").alias("variance"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as predictions of two keys and two look axes."""
    def e(i):
        return F.get("embedding", F.lit(i - 1)).cast("double")
    return table(spark, d, "embeddings").select(
        (F.col("vec_id") % 20).cast("string").alias("session"), F.col("vec_id").alias("last_idx"),
        F.when(F.col("vec_id") % 20 < 4, "holdout").otherwise("train").alias("side"),
        F.array((e(1) + 1) / 2, (e(2) + 1) / 2).alias("probs"),
        F.array((F.col("label") < 3).cast("int"), (F.col("label") % 2 == 0).cast("int")).alias("truth"),
        F.array(e(3), e(4) / 8).alias("look_pred"), F.array(e(5) * 40, e(6) * 20).alias("look_true"))


def images(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8x8 three-channel images."""
    def byte(x, c):
        return F.floor((x + 1) * 127.5).cast("int") if c == 0 else (
            F.floor((x + 1) * 60).cast("int") if c == 1 else F.floor((1 - x) * 100).cast("int"))
    pixels = F.flatten(F.transform(F.col("embedding"), lambda x: F.array(*[byte(x.cast("double"), c) for c in range(3)])))
    text = F.array_join(F.transform(pixels, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return table(spark, d, "embeddings").select(
        (F.col("vec_id") % 20).cast("string").alias("session"), F.col("vec_id").alias("frame_idx"),
        "label", F.unhex(text).alias("radar"))


# ---- the same views for DuckDB, as common table expressions ---------------------

EVENTS = """e as (select cast(user_id as varchar) as session, user_id, event_id, epoch_us(ts) / 1e6 as t,
  cast(json_extract_string(props, '$.k') as int) as k, event_type, value from events)"""

FRAMES = EVENTS + f""",
f as (select session, user_id, event_id, t, k, event_type, frame_idx, cast(floor(frame_idx / 20) as int) as chunk_idx,
  {', '.join(f'case when {rule} then 1 else 0 end as k_{key}' for key, rule in KEY_RULES.items())},
  {_COMMON.strip()}
  from (select *, row_number() over (partition by session order by t, event_id) - 1 as frame_idx from e))"""

PLAIN = EVENTS + """,
pf as (select session, t, event_id from e where event_type not in ('error', 'purchase'))"""

STATES = EVENTS + """,
su as (select session, t, event_id as n, k,
  k % 11 <> 0 and k % 13 <> 0 as has_local_state,
  case when k % 6 = 0 then true when k % 7 = 0 then false else false end as spectating,
  case when k % 11 = 0 or k % 13 = 0 then null when event_type = 'error' then 0 else k end as health,
  case when k % 29 = 0 then null when k % 4 = 0 then 'freezetime' when k % 3 = 0 then null else 'live' end as round_phase,
  case when k < 10 then 'warmup' else 'live' end as map_phase,
  case when k % 23 = 0 then null else k % 10 end as observer_slot,
  case when k % 8 = 0 then null else 'weapon_' || cast(k % 5 as varchar) end as active_weapon,
  case when k % 8 = 0 or k % 9 = 0 then null else k % 31 end as ammo_clip,
  case when k % 8 = 0 or k % 9 = 0 then null else k end as ammo_reserve,
  'u' || session as steamid,
  case when k % 6 = 0 then 'other' when k % 7 = 0 then null else 'u' || session end as player_steamid
  from e where event_type in ('error', 'purchase') and k % 17 <> 0),
st as (select *, not spectating as own_pov,
  case when health is null then null else not spectating and health > 0 end as alive from su)"""

SESSIONS = """s as (select cast(o.o_orderkey as varchar) as session, o.o_orderkey, o.o_orderstatus <> 'P' as complete,
  o.o_orderdate as modified, coalesce(i.n, 0) as n_frames,
  case when o.o_orderkey % 4 <> 0 then coalesce(i.n, 0) + case when o.o_orderkey % 10 = 0 then 1 else 0 end end as total_frames
  from orders o left join (select l_orderkey, count(*) as n from lineitem group by 1) i on o.o_orderkey = i.l_orderkey)"""

VARIANCE = """v as (select cast(doc_id % 40 as varchar) as session, doc_id // 40 as frame_idx,
  cast(n_chars as double) as variance, log10(cast(n_chars as double) + 1) as lv from documents)"""

PREDICTIONS = """p as (select cast(vec_id % 20 as varchar) as session, vec_id as last_idx,
  case when vec_id % 20 < 4 then 'holdout' else 'train' end as side,
  (cast(embedding[1] as double) + 1) / 2 as p1, (cast(embedding[2] as double) + 1) / 2 as p2,
  case when label < 3 then 1 else 0 end as y1, case when label % 2 = 0 then 1 else 0 end as y2,
  cast(embedding[3] as double) as lx, cast(embedding[4] as double) / 8 as ly,
  cast(embedding[5] as double) * 40 as tx, cast(embedding[6] as double) * 20 as ty from embeddings)"""
