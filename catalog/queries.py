"""Every registered query, next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replaylens.fixed_values import MOVEMENT_KEYS, PROBE_KEYS, RARE_KEYS
from replaylens.functions import actions, numeric, pixels, state
from replaylens.functions.geometry import geometry_columns
from replaylens.operators import (activity, asof, evaluate, events, frames as fr, probe, split, threshold,
                                  timing, validate, windows)
from replaylens.plans import inspection, training
from replaylens.session import written
from replaylens.sources import manifests, masks, state_log
from replaylens.streaming.state_stream import latest_state

from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FPS = 1 / 20_000  # events are hours apart, so the frame budget is scaled with them


def query(sql: str | None = None, ctes: str | None = None):
    """Register a query under its function's name."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = (f"with {ctes} {sql}" if ctes else sql).strip()
        return fn
    return add


def r6(*names: str):
    return {n: F.round(F.col(n), 6) for n in names}


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns(r6(*names))


def text(column) -> F.Column:
    """An array as comma-separated text, so that both engines hash the same value."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# ---- sessions ------------------------------------------------------------------

_JUDGED = v.SESSIONS + """,
j as (select *, case when complete = false then 'incomplete (complete=false)'
                     when n_frames = 0 then 'no chunks listed (empty session)' end as reason from s)"""


def _judged(spark, d):
    return manifests.judge(v.sessions(spark, d))


@query("select session, n_frames from j where reason is null", _JUDGED)
def usable_sessions(spark, d):
    return manifests.usable_sessions(_judged(spark, d)).select("session", "n_frames")


@query("select session, 'orders/' || session as path, reason from j where reason is not null", _JUDGED)
def skipped_sessions(spark, d):
    return manifests.skipped_sessions(_judged(spark, d))


@query("select cast(o_orderkey as varchar) as session from orders where not exists "
       "(select 1 from lineitem where l_orderkey = o_orderkey)")
def empty_sessions(spark, d):
    rows = v.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("session"))
    return validate.empty_sessions(v.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("session")), rows)


@query("select session, total_frames, n_frames as n_counted, coalesce(total_frames, n_frames) as n_frames, "
       "coalesce(total_frames <> n_frames, false) as mismatch from s", v.SESSIONS)
def session_lengths(spark, d):
    s = v.sessions(spark, d)
    return validate.session_lengths(s.drop("n_frames"), s.select("session", F.col("n_frames").alias("n_counted")))


@query("select session from s order by modified desc, 'orders/' || session desc limit 1", v.SESSIONS)
def newest_session(spark, d):
    return manifests.newest_session(v.sessions(spark, d)).select("session")


@query("select vnum as version, count(*) as n_sessions, case vnum when 1 then 'v1 single file' "
       "when 2 then 'v2 session folder (FPV only)' when 3 then 'v3 session folder (FPV + radar)' "
       "when 4 then 'v4 session folder (FPV + radar + GSI alive)' "
       "when 5 then 'v5 session folder (FPV + radar + GSI alive + state features)' "
       "else 'schema-v' || cast(vnum as varchar) || ' folder (newer than this tool knows)' end as kind "
       "from (select cast(o_orderkey % 7 + 1 as int) as vnum from orders) group by 1")
def kind_labels(spark, d):
    rows = v.table(spark, d, "orders").select((F.col("o_orderkey") % 7 + 1).cast("int").alias("version"))
    return rows.groupBy("version").agg(F.count(F.lit(1)).alias("n_sessions")).withColumn(
        "kind", state.kind_label(F.col("version"), F.lit(True)))


@query("select cast(o_orderkey as varchar) as session, cast(o_custkey % 7 + 1 as int) as chunk_version "
       "from orders where o_custkey % 7 + 1 > 5")
def unsupported_versions(spark, d):
    rows = v.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("session"),
                                              (F.col("o_custkey") % 7 + 1).cast("int").alias("chunk_version"))
    return validate.unsupported_chunks(rows)


@query("select cast(o_custkey % 3 as bigint) + 1920 as screen_w, 1080 as screen_h, 270 as fpv_w, 150 as fpv_h, "
       "10 as radar_left, 260 as radar_w, 128 as radar_out_w, count(*) as n_sessions from orders group by 1")
def geometry_report(spark, d):
    stamp = F.concat(F.lit("fullscreen "), (F.col("o_custkey") % 3 + 1920).cast("string"),
                     F.lit("x1080 -> crop L0T0W1920H1080 -> FPV 270x150 BGR; radar src L10T10W260H260 -> 128x128 BGR"))
    groups = validate.geometry_groups(v.table(spark, d, "orders").select(stamp.alias("geom")))
    return groups.select(*geometry_columns(), "n_sessions").select(
        F.col("screen_w").cast("long"), "screen_h", "fpv_w", "fpv_h", "radar_left", "radar_w", "radar_out_w", "n_sessions")


# ---- frames --------------------------------------------------------------------

@query("select session, count(*) as n_frames, count(dx) as n_dx, count(case when k > 0 then dy end) as n_dy, "
       "count(case when user_id % 3 = 0 then health end) as n_health, "
       "count(case when k % 50 <> 0 then ammo_clip end) as n_ammo_clip, "
       "count(case when k > 0 then dy end) = count(*) and count(case when k % 50 <> 0 then ammo_clip end) in (0, count(*)) "
       "as aligned from f group by session", v.FRAMES)
def alignment_check(spark, d):
    holes = v.frames(spark, d).selectExpr(
        "session", "dx", "case when k > 0 then dy end as dy", "case when user_id % 3 = 0 then health end as health",
        "case when k % 50 <> 0 then ammo_clip end as ammo_clip")
    return validate.alignment(holes, ["dx", "dy"], ["health", "ammo_clip"])


@query("select session, string_agg(cast(n as varchar), ',' order by chunk_idx) as chunk_lengths from "
       "(select session, chunk_idx, count(*) as n from f group by 1, 2) group by 1", v.FRAMES)
def chunk_lengths(spark, d):
    out = validate.chunk_lengths(v.frames(spark, d))
    return out.withColumn("chunk_lengths", text("chunk_lengths"))


@query("select session, event_id, frame_idx, row_number() over (order by session, frame_idx) - 1 as global_idx from f", v.FRAMES)
def frame_index(spark, d):
    f = v.frames(spark, d)
    lengths = f.groupBy("session").agg(F.count(F.lit(1)).alias("n_frames"))
    return fr.with_global_index(f.select("session", "event_id", "frame_idx"), lengths)


_KEYS = ["w", "a", "s", "d", "space", "ctrl", "shift", "1", "2", "3", "r"]


@query("select session, frame_idx, " + " || ',' || ".join(f"k_{k}" for k in _KEYS)
       + " || ',' || lclick || ',' || rclick || ',' || dx || ',' || dy as action, '"
       + ",".join(_KEYS) + ",lclick,rclick,dx,dy' as layout from f", v.FRAMES)
def action_vector(spark, d):
    return v.frames(spark, d).select(
        "session", "frame_idx", text(F.transform(actions.action_vector(), lambda x: x.cast("int"))).alias("action"),
        text(actions.action_layout()).alias("layout"))


@query("select session, frame_idx, k_w, k_a, k_s, k_d, k_shift, k_space from f", v.FRAMES)
def key_columns(spark, d):
    return v.frames(spark, d).select("session", "frame_idx", *actions.key_columns(MOVEMENT_KEYS))


@query("select session, frame_idx, cast(health as double) as f_health, cast(ammo_clip as double) as f_ammo_clip, "
       "cast(ammo_reserve as double) as f_ammo_reserve, active_weapon as f_weapon from f", v.FRAMES)
def state_features(spark, d):
    return v.frames(spark, d).select("session", "frame_idx", *state.state_features()).withColumns(
        {c: F.col(c).cast("double") for c in ("f_health", "f_ammo_clip", "f_ammo_reserve")})


_HELD = " || ".join(f"case when k_{k} = 1 then '+{k}' else '' end" for k in _KEYS)


@query(f"""select session, frame_idx, 'keys[' || case when h = '' then '-' else substr(h, 2) end || ']  click[' ||
  case when lclick + rclick = 0 then '-' else case when lclick = 1 then 'L' else '' end || case when rclick = 1 then 'R' else '' end end
  || ']  mouse(dx=' || case when dx >= 0 then '+' else '' end || dx || ', dy=' || case when dy >= 0 then '+' else '' end || dy || ')'
  as actions from (select *, {_HELD} as h from f)""", v.FRAMES)
def action_readout(spark, d):
    return v.frames(spark, d).select("session", "frame_idx", actions.action_text().alias("actions"))


@query("""select session, frame_idx, case when alive = 1 then 'ALIVE' else 'dead / spectating' end as life,
  'GSI: ' || case when alive = 1 then 'ALIVE' else 'dead' end || '  round[' || round_phase || ']  hp=' || lpad(cast(health as varchar), 3, ' ')
  || '  wpn[' || case when active_weapon = '' then '-' else active_weapon end || ']  ammo[' ||
  case when ammo_clip >= 0 then ammo_clip || '/' || ammo_reserve else '-' end || ']' as state from f""", v.FRAMES)
def state_readout(spark, d):
    return v.frames(spark, d).select("session", "frame_idx", state.life_label().alias("life"), state.state_text().alias("state"))


@query("select session, frame_idx from f where alive = 1 and round_phase <> 'freezetime' and coalesce(keep, true)", v.FRAMES)
def gameplay_filter(spark, d):
    return fr.gameplay(v.frames(spark, d), True, True).select("session", "frame_idx")


@query("""select session, count(*) as n_frames, count(*) filter (alive = 0) as n_masked_alive,
  count(*) filter (alive = 1 and round_phase = 'freezetime') as n_masked_freeze,
  count(*) filter (not coalesce(keep, true)) as n_masked_keep,
  count(*) filter (alive = 1 and round_phase <> 'freezetime' and coalesce(keep, true)) as n_served from f group by 1""", v.FRAMES)
def exclusion_accounting(spark, d):
    return fr.exclusions(v.frames(spark, d))


@query("select session, frame_idx, dx, case when k % 3 > 0 and user_id % 7 > 0 then k > 20 end as keep, "
       "coalesce(k % 3 > 0 and user_id % 7 > 0 and k <= 20, false) as dropped from f", v.FRAMES)
def mask_join(spark, d):
    f = v.frames(spark, d)
    lengths = f.groupBy("session").agg(F.count(F.lit(1)).alias("n_frames"))
    stale = F.when(F.col("user_id") % 7 == 0, 1).otherwise(0)  # these masks were built for another length
    mask = (f.where("k % 3 > 0").join(lengths, "session")
            .select("session", "frame_idx", (F.col("k") > 20).alias("keep"), (F.col("n_frames") + stale).alias("source_frames")))
    return fr.with_mask(f.select("session", "frame_idx", "dx"), masks.current_mask(mask, lengths))


@query("""select session, frame_idx, batch_id, place from (select session, frame_idx, (rn - 1) // 64 as batch_id,
  cast((rn - 1) % 64 as int) as place, n // 64 as whole from (select *, count(*) over () as n, row_number() over
  (order by md5(session || ':' || frame_idx || ':7'), session, frame_idx) as rn from f)) where batch_id < whole""", v.FRAMES)
def batch_ids(spark, d):
    return fr.batches(v.frames(spark, d).select("session", "frame_idx"), "frame_idx", 64, seed=7, drop_last=True)


@query("select l_orderkey * 10 + l_linenumber as pos, session, frame_idx, event_id, dx, dy, event_id is not null as found from "
       "(select distinct l_orderkey, l_linenumber, cast(l_suppkey as varchar) as session, cast(l_linenumber as bigint) * 3 as frame_idx "
       "from lineitem) left join f using (session, frame_idx)", v.FRAMES)
def fetch_batch(spark, d):
    request = v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("session"),
        (F.col("l_linenumber").cast("long") * 3).alias("frame_idx")).distinct().select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "session", "frame_idx")
    return fr.fetch(request, v.frames(spark, d).select("session", "frame_idx", "event_id", "dx", "dy"),
                    strict=False)


@query("select session, frame_idx, dx from f order by session, frame_idx limit 8", v.FRAMES)
def first_batch(spark, d):
    return fr.first_rows(v.frames(spark, d).select("session", "frame_idx", "dx"), 8)


_EVEN = """case when j = least({k}, n) - 1 then n - 1 else cast(floor(j * ((n - 1) / greatest(least({k}, n) - 1, 1.0))) as bigint) end"""


@query(f"""select distinct f.session, f.frame_idx, f.dx from f join (select session, {_EVEN.format(k=12)} as pos from
  (select session, count(*) as n from f group by 1), range(12) r(j) where j < least(12, n)) q
  on f.session = q.session and f.frame_idx = q.pos""", v.FRAMES)
def even_sample(spark, d):
    return fr.even_sample(v.frames(spark, d).select("session", "frame_idx", "dx"), 12)


@query(f"""select distinct g.session, g.frame_idx from g join (select session, {_EVEN.format(k=5)} as pos from
  (select session, count(*) as n from g group by 1), range(5) r(j) where j < least(5, n)) q
  on g.session = q.session and g.nth = q.pos""", v.FRAMES + """,
g as (select session, frame_idx, row_number() over (partition by session order by frame_idx) - 1 as nth from f where not coalesce(keep, true))""")
def even_sample_dropped(spark, d):
    f = v.frames(spark, d).select("session", "frame_idx", "keep")
    return fr.even_sample_where(f, ~fr.is_kept(), 5).select("session", "frame_idx")


# ---- split ---------------------------------------------------------------------

_SPLIT = v.FRAMES + """,
sp as (select session, n_frames, cast(cast(concat('0x', substr(md5(session), 1, 15)) as bigint) % 1000 as int) as bucket
       from (select session, count(*) as n_frames from f group by 1)),
sd as (select *, case when bucket < 200 then 'holdout' else 'train' end as side from sp)"""


def _lengths(spark, d):
    return v.frames(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("n_frames"))


def _split(spark, d):
    users = v.events(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("n_frames"))
    return split.split_sessions(users, hash_name="md5")


@query("select session, n_frames, bucket, case when session in ('1', '2') then 'holdout' else side end as side from sd", _SPLIT)
def split_md5(spark, d):
    users = v.events(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("n_frames"))
    return split.split_sessions(users, manual=["1", "2"], hash_name="md5")


@query("select session, count(*) as n_frames, true as in_range, true as follows, true as stable from f group by 1", v.FRAMES)
def split_blake2b(spark, d):
    """What the hashed split promises: buckets in range, sides that follow them, none moved by other sessions."""
    users = v.events(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("n_frames"))
    some = split.split_sessions(users.where("n_frames % 2 = 0")).select(
        "session", F.col("bucket").alias("then"), F.col("side").alias("side_then"))
    side = F.when(F.col("bucket") < 200, "holdout").otherwise("train")
    stable = F.col("then").isNull() | ((F.col("then") == F.col("bucket")) & (F.col("side_then") == F.col("side")))
    return split.split_sessions(users).join(some, "session", "left").select(
        "session", "n_frames", F.col("bucket").between(0, 999).alias("in_range"), (F.col("side") == side).alias("follows"),
        stable.alias("stable"))


@query("select x.side, count(session) as n_sessions, min(bucket) as min_bucket, max(bucket) as max_bucket, "
       "case when count(session) = 0 then x.side || ' is empty' end as note from (values ('train'), ('holdout')) x(side) "
       "left join sd using (side) group by 1", _SPLIT)
def split_report(spark, d):
    return split.split_report(_split(spark, d))


@query("""select session, n_frames, before, case when before < 0.6 * total then 'train' else 'holdout' end as side from
  (select *, cast(coalesce(sum(n_frames) over (order by n_frames desc, session rows between unbounded preceding and 1 preceding), 0) as bigint)
   as before, sum(n_frames) over () as total from s)""", v.SESSIONS)
def split_balanced(spark, d):
    # The split walks its session table a few times: store the counted join once.
    return split.balanced_split(written(v.sessions(spark, d).select("session", "n_frames"), "sessions"))


@query("""select side, count(*) as n_sessions, cast(sum(n_frames) as bigint) as n_frames, cast(sum(greatest(n_frames - 7, 0)) as bigint) as n_windows
  from sd group by 1""", _SPLIT)
def split_volume(spark, d):
    f = v.frames(spark, d).select("session", "frame_idx")
    return split.split_volume(f, windows.sliding_windows(f, 8), _split(spark, d))


@query("select session from sd where side = 'holdout' intersect select session from sd where side = 'train'", _SPLIT)
def split_disjoint(spark, d):
    s = _split(spark, d)
    return validate.shared_sessions(s.where("side = 'train'"), s.where("side = 'holdout'"))


# ---- joins by time -------------------------------------------------------------

@query("""select session, event_id as frame_idx, st.n as state_n, round(pf.t - st.t, 6) as state_age, st.alive, st.health, st.active_weapon
  from pf asof left join st using (session, t)""".replace("pf asof left join st using (session, t)",
       "pf asof left join st on pf.session = st.session and pf.t >= st.t").replace("select session", "select pf.session"),
       v.STATES + ",\n" + v.PLAIN.split(",\n", 2)[2])
def asof_state(spark, d):
    s = v.states(spark, d)
    packed = s.withColumn("state", F.struct("n", "state"))
    out = asof.asof_state(v.plain_frames(spark, d).drop("n"), packed)
    return rounded(out.select("session", "frame_idx", F.col("state.n").alias("state_n"), "state_age",
                              F.col("state.state.alive").alias("alive"), F.col("state.state.health").alias("health"),
                              F.col("state.state.active_weapon").alias("active_weapon")), "state_age")


@query("""select pf.session, event_id as frame_idx, cast(case when coalesce(alive, false) then 1 else 0 end as tinyint) as alive,
  coalesce(round_phase, '?') as round_phase, cast(coalesce(health, 0) as smallint) as health, coalesce(active_weapon, '') as active_weapon,
  cast(coalesce(ammo_clip, -1) as smallint) as ammo_clip, cast(coalesce(ammo_reserve, -1) as smallint) as ammo_reserve
  from pf asof left join st on pf.session = st.session and pf.t >= st.t""", v.STATES + ",\n" + v.PLAIN.split(",\n", 2)[2])
def stored_state(spark, d):
    out = asof.asof_state(v.plain_frames(spark, d).drop("n"), v.states(spark, d))
    return out.select("session", "frame_idx", *state.stored_state())


_MOUSE = v.PLAIN + """,
mo as (select session, t, cast(floor(value) as int) - 50 as dx, k - 50 as dy from e where event_type in ('error', 'purchase')),
hit as (select mo.session, pf.event_id as frame_idx, dx, dy from mo asof join pf on mo.session = pf.session and mo.t <= pf.t)"""


@query("""select pf.session, pf.event_id as frame_idx, cast(coalesce(h.dx, 0) as bigint) as dx, cast(coalesce(h.dy, 0) as bigint) as dy,
  coalesce(h.n, 0) as n_events from pf left join (select session, frame_idx, sum(dx) as dx, sum(dy) as dy, count(*) as n from hit group by 1, 2) h
  on pf.session = h.session and pf.event_id = h.frame_idx""", _MOUSE)
def mouse_accumulate(spark, d):
    return asof.accumulate_mouse(v.plain_frames(spark, d), v.mouse_events(spark, d))


_CONTACT = v.STATES + ",\n" + v.PLAIN.split(",\n", 2)[2] + """,
cr as (select session, round(ff, 6) as first_frame_t, round(fs, 6) as first_state_t, coalesce(fs <= ff + 86400, false) as contacted, ff, fs from
  (select session, min(t) as ff from pf group by 1) left join (select session, min(t) as fs from st group by 1) using (session))"""


@query("select session, first_frame_t, first_state_t, contacted from cr", _CONTACT)
def first_contact(spark, d):
    return rounded(asof.contact_report(v.plain_frames(spark, d), v.states(spark, d), 86400.0), "first_frame_t", "first_state_t")


@query("select pf.session, pf.event_id as frame_idx from pf join cr using (session) where contacted and t >= fs", _CONTACT)
def after_contact(spark, d):
    return asof.after_contact(v.plain_frames(spark, d).drop("n"), v.states(spark, d), 86400.0).select("session", "frame_idx")


# ---- windows -------------------------------------------------------------------

_KEPT = v.FRAMES + """,
kept as (select *, frame_idx - row_number() over (partition by session order by frame_idx) as run from f
         where alive = 1 and round_phase <> 'freezetime'),
win as (select *, row_number() over (partition by session, run order by frame_idx) as place from kept)"""


def _kept(spark, d):
    return fr.gameplay(v.frames(spark, d), gameplay_filter=True)


@query("select session, min(frame_idx) as run_start, max(frame_idx) as run_end, count(*) as run_length from kept group by session, run", _KEPT)
def runs(spark, d):
    return windows.runs(_kept(spark, d))


@query("select session, frame_idx - 7 as first_idx, frame_idx as last_idx, dx, dy from f where frame_idx >= 7", v.FRAMES)
def windows_t8(spark, d):
    return windows.sliding_windows(v.frames(spark, d).select("session", "frame_idx", "dx", "dy"), 8)


@query("select session, frame_idx - 2 as first_idx, frame_idx as last_idx from win where place >= 3", _KEPT)
def windows_gameplay(spark, d):
    return windows.sliding_windows(_kept(spark, d).select("session", "frame_idx"), 3)


@query("""select session, count(*) as runs, count(*) filter (n < 3) as runs_too_short, cast(sum(greatest(n - 2, 0)) as bigint) as windows
  from (select session, run, count(*) as n from kept group by 1, 2) group by 1""", _KEPT)
def window_stats(spark, d):
    return windows.window_stats(_kept(spark, d), 3)


@query("""select session, frame_idx as last_idx, d2 || ',' || d1 || ',' || dx as window_dx from (select *, lag(dx, 1) over w as d1, lag(dx, 2) over w as d2
  from win window w as (partition by session, run order by frame_idx)) where place >= 3""", _KEPT)
def window_gather(spark, d):
    w = windows.sliding_windows(_kept(spark, d).select("session", "frame_idx", "dx"), 3, gather=["dx"])
    return w.select("session", "last_idx", text("w_dx").alias("window_dx"))


_SIDED = _KEPT + """,
sd as (select session, case when cast(concat('0x', substr(md5(session), 1, 15)) as bigint) % 1000 < 200 then 'holdout' else 'train' end as side
       from (select distinct session from e)),
sw as (select * from win join sd using (session) where place >= 3)"""


@query("select side, count(*) as n_windows, " + ", ".join(f"round(avg(k_{k}), 6) as held_{k}" for k in PROBE_KEYS)
       + " from win join sd using (session) where place >= 4 group by 1", _SIDED)
def key_balance_windows(spark, d):
    """Held fraction of each key per split side over clean, consecutive windows."""
    sided = split.with_side(v.frames(spark, d), _split(spark, d))
    out = training.window_key_balance(sided, PROBE_KEYS, 4)
    return rounded(out, *[f"held_{k}" for k in PROBE_KEYS])


def _windows(spark, d):
    kept = _kept(spark, d).select("session", "frame_idx", "dx", "dy", *actions.key_columns(MOVEMENT_KEYS))
    return windows.sliding_windows(kept, 3)


@query("select count(*) as n_windows, " + ", ".join(
    f"round(avg({a}), 6) as {a}_mean, round(stddev_pop({a}), 6) as {a}_std, round(avg(abs({a})), 6) as {a}_mean_abs" for a in ("dx", "dy"))
    + " from win where place >= 3", _KEPT)
def look_balance(spark, d):
    return rounded(windows.look_balance(_windows(spark, d)), *[f"{a}_{s}" for a in ("dx", "dy") for s in ("mean", "std", "mean_abs")])


_EVENTFUL = _KEPT + """,
ev as (select session, frame_idx as last_idx, rare_hit, dx_hit, rare_hit or dx_hit as eventful from (select *,
  greatest(k_a, k_s, k_d, k_space) = 1 as rare_hit, abs(dx) > (select stddev_pop(dx) from win where place >= 3) as dx_hit
  from win where place >= 3))"""


@query("select * from ev", _EVENTFUL)
def eventful(spark, d):
    out = windows.flag_eventful(_windows(spark, d), MOVEMENT_KEYS, RARE_KEYS)
    return out.select("session", "last_idx", "rare_hit", "dx_hit", "eventful")


@query("select count(*) as n, count(*) filter (eventful) as eventful, count(*) filter (rare_hit) as rare_hit, "
       "count(*) filter (dx_hit) as dx_hit from ev", _EVENTFUL)
def eventful_counts(spark, d):
    return windows.eventful_counts(windows.flag_eventful(_windows(spark, d), MOVEMENT_KEYS))


@query("select session, last_idx, cast(c as int) as copy from ev, range(1, 4) r(c) where c = 1 or eventful", _EVENTFUL)
def oversample(spark, d):
    flagged = windows.flag_eventful(_windows(spark, d), MOVEMENT_KEYS)
    return windows.oversample(flagged, 3).select("session", "last_idx", "copy")


@query("""select session, last_idx, cast(c as int) as copy, (row_number() over (order by md5(session || ':' || (last_idx * 10 + c) || ':3'), session, last_idx * 10 + c) - 1) // 32 as batch_id
  from ev, range(1, 4) r(c) where c = 1 or eventful""", _EVENTFUL)
def oversample_batches(spark, d):
    flagged = windows.oversample(windows.flag_eventful(_windows(spark, d), MOVEMENT_KEYS), 3)
    rows = flagged.select("session", "last_idx", "copy", (F.col("last_idx") * 10 + F.col("copy")).alias("draw"))
    return fr.batches(rows, "draw", 32, seed=3).drop("draw", "place")


@query(f"""select session, last_idx from (select session, frame_idx as last_idx, row_number() over (order by session, frame_idx) - 1 as pos
  from win where place >= 3) where pos in (select {_EVEN.format(k=200)} from (select count(*) as n from win where place >= 3), range(200) r(j) where j < least(200, n))""", _KEPT)
def stride_sample(spark, d):
    w = windows.sliding_windows(_kept(spark, d).select("session", "frame_idx"), 3).select("session", "last_idx")
    return fr.stride_sample(w, 200).select("session", "last_idx")


# ---- inspection ----------------------------------------------------------------

_GAPS = v.FRAMES + """,
g as (select session, frame_idx, chunk_idx, lead(t) over w - t as gap, lead(chunk_idx) over w <> chunk_idx as at_boundary,
  lead(alive) over w <> alive as flips from f window w as (partition by session order by frame_idx)),
gg as (select *, case when cast(session as bigint) % 2 = 0 then 20000 else 40000 end as budget from g where gap is not null)"""
_TIMING = ["fps", "mean_ms", "max_ms", "min_ms", "jitter_ms"]


def _two_rates(spark, d):
    """Frames of sessions recorded at two rates."""
    return v.frames(spark, d).withColumn("file_fps", F.when(F.col("user_id") % 2 == 0, FPS).otherwise(FPS / 2))


def _gaps(spark, d):
    return timing.gaps(_two_rates(spark, d))


@query("""select session, count(*) + 1 as n_frames, round(1e6 / avg(gap), 4) as fps, round(avg(gap), 4) as mean_ms, round(max(gap), 4) as max_ms,
  round(min(gap), 4) as min_ms, round(stddev_pop(gap), 4) as jitter_ms, count(*) filter (gap > 1.8 * budget) as long_gaps from gg group by 1""", _GAPS)
def timing_summary(spark, d):
    return _in_seconds(timing.timing_summary(_gaps(spark, d)))


def _in_seconds(out):
    """Gaps are hours: report seconds."""
    scaled = {c: F.round(F.col(c) / 1000, 4) for c in _TIMING[1:]}
    return out.withColumns({**scaled, "fps": F.round(F.col("fps") * 1e6, 4)})


@query("""select session, rank, frame_idx, round(gap * 1000, 3) as gap_ms, at_boundary from (select *, cast(row_number() over
  (partition by session order by gap desc, frame_idx) as int) as rank from gg) where rank <= 5""", _GAPS)
def top_gaps(spark, d):
    return timing.largest_gaps(_gaps(spark, d)).withColumn("gap_ms", F.round("gap_ms", 3))


@query("select session, chunk_idx, frame_idx + 1 as boundary, round(gap * 1000, 3) as gap_ms from gg where at_boundary", _GAPS)
def boundary_gaps(spark, d):
    return timing.boundary_gaps(_gaps(spark, d)).withColumn("gap_ms", F.round("gap_ms", 3))


@query("""select session, boundaries, stalls, boundary_stalls, round(boundary_stalls / greatest(stalls, 1), 6) as boundary_share,
  case when boundaries = 0 then 'single chunk' when boundary_stalls > 0 then 'boundary stalls' else 'stalls elsewhere' end as diagnosis
  from (select session, count(*) filter (at_boundary) as boundaries, count(*) filter (gap > 3 * budget) as stalls,
  count(*) filter (gap > 3 * budget and at_boundary) as boundary_stalls from gg group by 1)""", _GAPS)
def stall_diagnosis(spark, d):
    return rounded(timing.stall_diagnosis(_gaps(spark, d)), "boundary_share")


@query("select session, count(*) filter (flips) as alive_flips from gg group by 1", _GAPS)
def alive_flips(spark, d):
    return timing.alive_flips(_gaps(spark, d))


@query("select session, key, frames_held, round(100.0 * frames_held / n, 6) as pct_held from (select session, count(*) as n, "
       + ", ".join(f"cast(sum(k_{k}) as bigint) as c_{k}" for k in _KEYS)
       + ", count(*) filter (k % 2 = 0) as c_mouse4, count(*) filter (k % 17 = 0) as c_tab from f group by 1), lateral (values "
       + ", ".join(f"('{k}', c_{k})" for k in [*_KEYS, "mouse4", "tab"]) + ") x(key, frames_held)", v.FRAMES)
def key_activity(spark, d):
    """Sessions that log two keys more than usual."""
    more = F.array((F.col("k") % 2 == 0).cast("tinyint"), (F.col("k") % 17 == 0).cast("tinyint"))
    frames = v.frames(spark, d).withColumns({
        "keys": F.concat("keys", more), "key_names": F.concat("key_names", F.array(F.lit("mouse4"), F.lit("tab")))})
    return rounded(activity.key_activity(frames), "pct_held")


@query("""select session, cast(sum(lclick) as bigint) as left_held, round(100.0 * sum(lclick) / count(*), 6) as left_pct,
  cast(sum(rclick) as bigint) as right_held, round(100.0 * sum(rclick) / count(*), 6) as right_pct from f group by 1""", v.FRAMES)
def clicks(spark, d):
    return rounded(activity.clicks(v.frames(spark, d)), "left_pct", "right_pct")


@query("""select session, min(dx) as dx_min, max(dx) as dx_max, round(avg(abs(dx)), 6) as dx_mean_abs, min(dy) as dy_min, max(dy) as dy_max,
  round(avg(abs(dy)), 6) as dy_mean_abs, count(*) filter (dx <> 0) as dx_moving, round(100.0 * count(*) filter (dx <> 0) / count(*), 6) as dx_moving_pct,
  min(dx) = 0 and max(dx) = 0 as mouse_dead from f group by 1""", v.FRAMES)
def mouse_summary(spark, d):
    return rounded(activity.mouse_summary(v.frames(spark, d)), "dx_mean_abs", "dy_mean_abs", "dx_moving_pct")


@query("""select session, n_alive, n - n_alive as n_not_alive, round(100.0 * n_alive / n, 6) as alive_pct, case when n_alive = 0 then 'no alive frames'
  when n_alive = n then 'every frame alive' else 'mixed' end as alive_note from (select session, count(*) as n, count(*) filter (alive = 1) as n_alive from f group by 1)""", v.FRAMES)
def alive_summary(spark, d):
    return rounded(activity.alive_summary(v.frames(spark, d)), "alive_pct")


@query("select session, round_phase, count(*) as n from f group by 1, 2", v.FRAMES)
def phase_dist(spark, d):
    return activity.phase_counts(v.frames(spark, d))


@query("""select session, count(*) filter (alive = 1) as health_n, min(health) filter (alive = 1) as health_min, max(health) filter (alive = 1) as health_max,
  round(avg(health) filter (alive = 1), 6) as health_mean, count(*) filter (ammo_clip >= 0) as ammo_n, min(ammo_clip) filter (ammo_clip >= 0) as clip_min,
  max(ammo_clip) filter (ammo_clip >= 0) as clip_max, min(ammo_reserve) filter (ammo_clip >= 0) as reserve_min,
  max(ammo_reserve) filter (ammo_clip >= 0) as reserve_max, max(length(active_weapon)) = 0 as weapon_always_empty from f group by 1""", v.FRAMES)
def health_ammo(spark, d):
    return rounded(activity.health_ammo(v.frames(spark, d)), "health_mean")


@query("""select session, active_weapon, n, rank from (select *, cast(row_number() over (partition by session order by n desc, active_weapon) as int) as rank
  from (select session, active_weapon, count(*) as n from f group by 1, 2)) where rank <= 3""", v.FRAMES)
def top_weapons(spark, d):
    return activity.top_weapons(v.frames(spark, d), 3)


_PARTS = ["clicks", "mouse_summary", "alive_summary", "health_ammo"]


@query("select * from (select session, count(*) as frames from f group by 1) "
       + " ".join(f"join ({ORACLES[name]}) using (session)" for name in _PARTS)
       + f" left join (select * exclude (n_frames) from ({ORACLES['timing_summary']})) using (session)"
       + f" left join ({ORACLES['stall_diagnosis']}) using (session) left join ({ORACLES['alive_flips']}) using (session)", v.FRAMES)
def inspection_report(spark, d):
    out = _in_seconds(inspection.inspect_frames(_two_rates(spark, d)))
    return rounded(out, "left_pct", "right_pct", "dx_mean_abs", "dy_mean_abs", "dx_moving_pct", "alive_pct", "health_mean",
                   "boundary_share")


# ---- events --------------------------------------------------------------------

_LAST = v.STATES + """,
ls as (select *, lag(health) over w as p_health, lag(alive) over w as p_alive, lag(active_weapon) over w as p_weapon, lag(round_phase) over w as p_round,
  lag(map_phase) over w as p_map, lag(spectating) over w as p_spect, row_number() over w as rn,
  coalesce(max(cast(has_local_state as int)) over (w rows between unbounded preceding and 1 preceding), 0) as had_local,
  coalesce(max(cast(spectating as int)) over (w rows between unbounded preceding and 1 preceding), 0) as had_spect
  from st window w as (partition by session order by t, n)),
ch as (select session, n, alive, spectating, coalesce(p_alive, false) and not coalesce(alive, false) as died,
  case when has_local_state and had_local = 0 then ',local_state' else '' end ||
  case when health is not null and p_health is not null and health <> p_health then ',health' else '' end ||
  case when coalesce(p_alive, false) and not coalesce(alive, false) then ',death' else '' end ||
  case when active_weapon is distinct from p_weapon then ',weapon' else '' end ||
  case when spectating and had_spect = 0 then ',spectating' else '' end ||
  case when round_phase is distinct from p_round then ',round_phase' else '' end ||
  case when map_phase is distinct from p_map then ',map_phase' else '' end as changed,
  case when alive is distinct from p_alive then ',alive' else '' end || case when health is distinct from p_health then ',health' else '' end ||
  case when round_phase is distinct from p_round then ',round_phase' else '' end || case when map_phase is distinct from p_map then ',map_phase' else '' end ||
  case when active_weapon is distinct from p_weapon then ',active_weapon' else '' end ||
  case when rn = 1 or spectating is distinct from p_spect then ',spectating' else '' end as watched from ls)"""


@query("""select session, n, has_local_state, spectating, own_pov, health, alive, round_phase, map_phase, 'playing' as activity, observer_slot,
  active_weapon, ammo_clip, ammo_reserve, steamid, player_steamid from st""", v.STATES)
def state_extract(spark, d):
    return v.states(spark, d).select("session", "n", "state.*")


@query("""select session, count(*) filter (k % 17 <> 0) as n_updates, count(*) filter (k % 17 = 0) as n_bad,
  count(*) filter (k % 17 <> 0 and k % 10 = 0) as n_token_mismatch from e where event_type in ('error', 'purchase') group by 1""", v.EVENTS)
def update_quality(spark, d):
    return state_log.update_quality(v.updates(spark, d))


@query("select session, n, substr(changed, 2) as changed from ch where changed <> ''", _LAST)
def change_events(spark, d):
    return events.change_events(v.states(spark, d)).select("session", "n", text("changed").alias("changed"))


@query("select session, n, substr(watched, 2) as changed from ch where watched <> ''", _LAST)
def watched_changes(spark, d):
    return events.watched_changes(v.states(spark, d)).select("session", "n", text("changed").alias("changed"))


@query("select session, n, case when spectating then 'spectating' else 'health 0' end as reason from ch where died", _LAST)
def death_events(spark, d):
    return events.death_events(v.states(spark, d)).select("session", "n", "reason")


@query("""select session, count(*) as n_updates, round(max(t) - min(t), 4) as span_s, round(avg(gap), 4) as mean_gap, round(list_sort(list(gap) filter (gap is not null))[count(gap) // 2 + 1], 4) as p50_gap,
  round(list_sort(list(gap) filter (gap is not null))[least(count(gap) - 1, cast(floor(0.95 * count(gap)) as bigint)) + 1], 4) as p95_gap,
  case when max(t) > min(t) then round(count(*) / (max(t) - min(t)) * 1e6, 4) end as per_second
  from (select *, t - lag(t) over (partition by session order by t, n) as gap from st) group by 1""", v.STATES)
def cadence(spark, d):
    out = events.cadence(v.states(spark, d))
    return out.withColumns({c: F.round(c, 4) for c in ("span_s", "mean_gap", "p50_gap", "p95_gap")}).withColumn(
        "per_second", F.round(F.col("per_second") * 1e6, 4))


@query("""select session, count(*) as n_updates, bool_or(has_local_state) as saw_local_state, bool_or(health is not null) as saw_health,
  count(*) filter (coalesce(p_alive, false) and not coalesce(alive, false)) as deaths, bool_or(spectating) as saw_spectating, min(steamid) as own_id,
  case when bool_or(has_local_state) and bool_or(health is not null) then 'FEASIBLE' else 'PARTIAL' end as verdict from ls group by 1""", _LAST)
def feasibility(spark, d):
    return events.feasibility(v.states(spark, d))


_COVER = v.STATES + ",\n" + v.PLAIN.split(",\n", 2)[2] + """,
sa as (select pf.session, coalesce(alive, false) as alive, coalesce(spectating, false) as spect, health
       from pf asof left join st on pf.session = st.session and pf.t >= st.t)"""


@query("""select *, case when spectating_alive then 'FAIL' when saw_alive and saw_spectating then 'PASS' when saw_alive and saw_own_death then 'PARTIAL: no spectating seen'
  when saw_alive then 'PARTIAL: no death seen' else 'INCONCLUSIVE' end as verdict from (select session, bool_or(alive) as saw_alive, bool_or(spect) as saw_spectating,
  bool_or(alive and spect) as spectating_alive, bool_or(not alive and not spect and coalesce(health = 0, false)) as saw_own_death from sa group by 1)""", _COVER)
def coverage_verdict(spark, d):
    out = asof.asof_state(v.plain_frames(spark, d), v.states(spark, d))
    return events.coverage(out.select("session", "state", *state.stored_state()))


@query("select session, max_by(n, t) as last_n, round(max(t), 6) as state_t, count(*) as n_updates from st group by 1", v.STATES)
def latest_slot(spark, d):
    s = v.states(spark, d).withColumn("state", F.struct("n", "state"))
    return rounded(latest_state(s).select("session", F.col("state.n").alias("last_n"), "state_t", "n_updates"), "state_t")


@query("""select session, frame_idx, coalesce(min(case when kp then frame_idx end) over nx, frame_idx) as next_kept,
  coalesce(min(case when not kp then frame_idx end) over nx, frame_idx) as next_dropped, coalesce(max(case when kp then frame_idx end) over pv, frame_idx) as prev_kept,
  coalesce(max(case when not kp then frame_idx end) over pv, frame_idx) as prev_dropped from (select *, coalesce(keep, true) as kp from f)
  window nx as (partition by session order by frame_idx rows between 1 following and unbounded following),
  pv as (partition by session order by frame_idx rows between unbounded preceding and 1 preceding)""", v.FRAMES)
def next_kept(spark, d):
    f = v.frames(spark, d).select("session", "frame_idx", fr.is_kept().alias("keep"))
    return events.neighbours_in_state(f).select("session", "frame_idx", "next_kept", "next_dropped", "prev_kept", "prev_dropped")


_SWITCH = v.FRAMES + """,
sc as (select session, frame_idx as k, coalesce(sum(case when dx > 0 then 1 else 0 end) over pv, 0) +
  sum(case when dx < 0 then 1 else 0 end) over (partition by session order by frame_idx rows between current row and unbounded following) as score,
  count(*) over (partition by session) as n from f window pv as (partition by session order by frame_idx rows between unbounded preceding and 1 preceding)),
sb as (select session, n, k as best_k, cast(score as bigint) as best_score from (select *, row_number() over (partition by session order by score desc, k) as rn from sc where k >= 1) where rn = 1)"""


@query("select session, n, best_k, best_score, round(best_score / n, 6) as separation from sb", _SWITCH)
def switch_point(spark, d):
    return rounded(events.switch_point(v.frames(spark, d).select("session", "frame_idx", "dx")), "separation")


@query("""select session, split_at, round(rm, 6) as right_mean, round(lm, 6) as left_mean, round(rs, 6) as right_share, round(ls, 6) as left_share, n, best_k, best_score,
  round(best_score / n, 6) as separation, case when rm > 0 and rs >= 0.8 and lm < 0 and ls >= 0.8 and abs(best_k - split_at) <= 22 then 'PASS'
  when rm > 0 and rs >= 0.8 and lm < 0 and ls >= 0.8 then 'MOSTLY OK' else 'FAIL' end as verdict from (select session, split_at,
  avg(case when frame_idx < split_at then dxx end) as rm, avg(case when frame_idx >= split_at then dxx end) as lm,
  coalesce(count(*) filter (frame_idx < split_at and dxx > 0) / nullif(count(*) filter (frame_idx < split_at and dxx <> 0), 0), 0) as rs,
  coalesce(count(*) filter (frame_idx >= split_at and dxx < 0) / nullif(count(*) filter (frame_idx >= split_at and dxx <> 0), 0), 0) as ls from swept group by 1, 2) join sb using (session)""",
       _SWITCH.replace("from f window pv", "from swept window pv").replace("dx > 0", "dxx > 0").replace("dx < 0", "dxx < 0").replace(
           ",\nsc as", """,
swept as (select session, frame_idx, half as split_at, case when k % 9 = 0 then 0 when k % 10 = 0 then -5 when frame_idx < half + user_id % 40 - 5 then 10 else -10 end as dxx
  from (select *, (count(*) over (partition by session)) // 2 as half from f)),
sc as"""))
def sync_verdict(spark, d):
    f = v.frames(spark, d)
    splits = _lengths(spark, d).select("session", F.floor(F.col("n_frames") / 2).alias("split_at"))
    swept = f.join(splits, "session").selectExpr(
        "session", "frame_idx", "case when k % 9 = 0 then 0 when k % 10 = 0 then -5 "
        "when frame_idx < split_at + user_id % 40 - 5 then 10 else -10 end as dx")
    return rounded(events.sync_verdict(swept, splits), "right_mean", "left_mean", "right_share", "left_share", "separation")


_EDGES = v.FRAMES + """,
kk as (select session, frame_idx, x.key, x.held, max(frame_idx) over (partition by session) as last_idx from f, lateral (values
  ('w', k_w), ('a', k_a), ('s', k_s), ('d', k_d)) x(key, held)),
ed as (select *, coalesce(lag(held) over (partition by session, key order by frame_idx), 0) as was from kk)"""


@query("""select session, frame_idx, case when held = 1 then 'press' else 'release' end as event, key from ed where held <> was
  union all select session, frame_idx, 'release_all', key from ed where held = 1 and frame_idx = last_idx""", _EDGES)
def edge_events(spark, d):
    f = v.frames(spark, d).select("session", "frame_idx", actions.held_keys().alias("held"))
    return events.key_edges(f, PROBE_KEYS)


# ---- thresholds ----------------------------------------------------------------

def _hist_sql(bins: int) -> str:
    return v.VARIANCE + f""",
rg as (select min(lv) as lo, max(lv) as hi from v),
hb as (select bin, count(*) as n from (select least({bins - 1}, cast(floor((lv - lo) / (hi - lo) * {bins}) as int)) as bin from v, rg) group by 1),
h as (select cast(b as int) as bin, lo + b * ((hi - lo) / {bins}) as elo, lo + (b + 1) * ((hi - lo) / {bins}) as ehi, coalesce(n, 0) as n
      from range({bins}) r(b) cross join rg left join hb on hb.bin = b)"""


_OTSU = _hist_sql(256) + """,
o1 as (select bin, (elo + ehi) / 2 as c, n / sum(n) over () as w from h where n > 0),
o2 as (select bin, c, sum(w) over (order by bin) as w0, sum(w * c) over (order by bin) as m0, sum(w * c) over () as m from o1),
o3 as (select bin, c, case when w0 > 1e-12 and 1 - w0 > 1e-12 then w0 * (1 - w0) * (m0 / w0 - (m - m0) / (1 - w0)) ** 2 else 0 end as score from o2),
o4 as (select bin as cut_bin, c as thr_log, 10 ** c - 1 as threshold from o3 order by score desc, bin limit 1)"""


@query("select bin, round(elo, 6) as lo, round(ehi, 6) as hi, n from h", _hist_sql(256))
def variance_hist(spark, d):
    return rounded(threshold.histogram(v.variance(spark, d)), "lo", "hi")


@query("select bin, round(elo, 6) as lo, round(ehi, 6) as hi, n from h", _hist_sql(12))
def variance_report_hist(spark, d):
    return rounded(threshold.report_histogram(v.variance(spark, d)), "lo", "hi")


@query("select cut_bin, round(thr_log, 6) as threshold_log, round(threshold, 4) as threshold, 'otsu split' as reason from o4", _OTSU)
def otsu_cut(spark, d):
    out = threshold.otsu_cut(threshold.histogram(v.variance(spark, d)))
    return rounded(out, "threshold_log").withColumn("threshold", F.round("threshold", 4))


@query("""select cut_bin, round(threshold, 4) as threshold, 'otsu split' as reason, n_frames, n_low, round(n_low / n_frames, 6) as frac_below, round(hm - lm, 6) as gap_decades, hm - lm >= 1.5 as bimodal
  from (select cut_bin, threshold, count(*) as n_frames, count(*) filter (lv <= thr_log) as n_low, avg(lv) filter (lv <= thr_log) as lm, avg(lv) filter (lv > thr_log) as hm from v, o4 group by 1, 2)""", _OTSU)
def bimodal(spark, d):
    return rounded(threshold.pooled_cut(v.variance(spark, d)).withColumn("threshold", F.round("threshold", 4)), "frac_below", "gap_decades")


def _mask(spark, d):
    rows = v.variance(spark, d)
    return masks.build_mask(rows, threshold.otsu_cut(threshold.histogram(rows)))


_MASK = _OTSU + ",\nmk as (select session, frame_idx, variance > threshold as keep, variance, threshold, count(*) over (partition by session) as source_frames from v, o4)"


@query("select session, frame_idx, keep, variance, round(threshold, 4) as threshold, source_frames from mk", _MASK)
def keep_mask(spark, d):
    return _mask(spark, d).withColumn("threshold", F.round("threshold", 4))


@query("select session, frame_idx, variance > 1000 as keep, variance, cast(1000 as double) as threshold, source_frames from mk", _MASK)
def rethreshold(spark, d):
    return masks.rethreshold(_mask(spark, d), 1000.0)


@query("""select session, count(*) as total_frames, count(*) filter (keep) as kept, count(*) filter (not keep) as dropped, round(max(threshold), 4) as threshold,
  round(count(*) filter (not keep) / count(*), 6) as dropped_frac from mk group by 1""", _MASK)
def clean_report(spark, d):
    out = threshold.clean_report(_mask(spark, d))
    return rounded(out.withColumn("threshold", F.round("threshold", 4)), "dropped_frac")


@query("""select count(distinct session) as n_sessions, count(*) as total_frames, count(*) filter (keep) as kept, count(*) filter (not keep) as dropped,
  round(count(*) filter (not keep) / count(*), 6) as dropped_frac from mk""", _MASK)
def clean_total(spark, d):
    return rounded(threshold.clean_total(threshold.clean_report(_mask(spark, d))), "dropped_frac")


@query("select count(*) as n, min(variance) as lowest, median(variance) as median, max(variance) as highest from v", v.VARIANCE)
def variance_summary(spark, d):
    return threshold.variance_summary(v.variance(spark, d))


@query("select session, frame_idx from v, o4 where variance > threshold", _OTSU)
def blank_filter(spark, d):
    rows = v.variance(spark, d)
    cut = threshold.otsu_cut(threshold.histogram(rows)).select("threshold").scalar()
    return fr.above_threshold(rows, cut).select("session", "frame_idx")


@query("select session, frame_idx, round(lv, 6) as log_variance from v", v.VARIANCE)
def log_variance(spark, d):
    return v.variance(spark, d).select("session", "frame_idx", F.round(numeric.log_variance(F.col("variance")), 6).alias("log_variance"))


# ---- predictions ---------------------------------------------------------------

_LIFT = v.PREDICTIONS + """,
kx as (select side, x.key, x.prob, x.y from p, lateral (values ('w', p1, y1), ('a', p2, y2)) x(key, prob, y)),
kr as (select side, key, count(*) as n, avg(cast((prob >= 0.5) = (y = 1) as int)) as acc, avg(y) as held from kx group by 1, 2),
tr as (select key, held as rate from kr where side = 'train'),
lf as (select side, key, n, acc, held, greatest(rate, 1 - rate) as baseline, acc - greatest(rate, 1 - rate) as lift from kr join tr using (key))"""
_TWO = ["w", "a"]


@query("select side, key, n, round(acc, 6) as acc, round(held, 6) as held, round(baseline, 6) as baseline, round(lift, 6) as lift from lf", _LIFT)
def key_lift(spark, d):
    return rounded(evaluate.key_lift(v.predictions(spark, d), _TWO), "acc", "held", "baseline", "lift")


@query("select side, key, n, round(acc, 6) as acc, round(held, 6) as held, round(greatest(held, 1 - held), 6) as baseline, "
       "round(acc - greatest(held, 1 - held), 6) as lift from kr", _LIFT)
def key_lift_same_side(spark, d):
    return rounded(evaluate.key_lift(v.predictions(spark, d), _TWO, "same"), "acc", "held", "baseline", "lift")


@query("select round(a, 6) as train_lift, round(b, 6) as holdout_lift, round(a - b, 6) as gap from (select avg(lift) filter (side = 'train') as a, "
       "avg(lift) filter (side = 'holdout') as b from lf)", _LIFT)
def mean_lift(spark, d):
    return rounded(evaluate.mean_lift(evaluate.key_lift(v.predictions(spark, d), _TWO)), "train_lift", "holdout_lift", "gap")


@query("""select side, axis, count(*) as n, round(avg(abs(pr - tr)), 6) as mae, round(avg(abs(tr)), 6) as baseline, round(avg(abs(tr)) - avg(abs(pr - tr)), 6) as improve
  from (select side, x.* from p, (select avg(tx) as mx, greatest(stddev_pop(tx), 1) as sx, avg(ty) as my, greatest(stddev_pop(ty), 1) as sy from p where side = 'train') s,
  lateral (values ('dx', lx * sx + mx, tx), ('dy', ly * sy + my, ty)) x(axis, pr, tr)) group by 1, 2""", v.PREDICTIONS)
def look_mae(spark, d):
    p = v.predictions(spark, d)
    truth = p.where("side = 'train'").select(F.get("look_true", F.lit(0)).alias("dx"), F.get("look_true", F.lit(1)).alias("dy"))
    return rounded(evaluate.look_error(p, windows.look_balance(truth)), "mae", "baseline", "improve")


@query("""select key, count(*) as n, round(avg(y), 6) as true_rate, round(avg(pr), 6) as pred_rate, round(sum(pr * y) / greatest(sum(pr), 1e-9), 6) as precision,
  round(sum(pr * y) / greatest(sum(y), 1e-9), 6) as recall, round(avg(prob), 6) as mean_prob from (select *, case when prob >= 0.5 then 1 else 0 end as pr from kx) group by 1""", _LIFT)
def confusion(spark, d):
    out = evaluate.confusion(v.predictions(spark, d), _TWO, 0.5)
    return rounded(out, "true_rate", "pred_rate", "precision", "recall", "mean_prob")


@query("""select axis, count(*) as n, round(stddev_pop(tr), 6) as truth_std, round(stddev_pop(pr), 6) as pred_std, round(corr(tr, pr), 6) as corr, round(avg(pr), 6) as pred_mean,
  round(avg(tr), 6) as truth_mean, stddev_pop(pr) / greatest(stddev_pop(tr), 1e-9) < 0.25 as collapsed from p, lateral (values ('dx', lx, tx), ('dy', ly, ty)) x(axis, pr, tr) group by 1""", v.PREDICTIONS)
def collapse(spark, d):
    return rounded(evaluate.look_collapse(v.predictions(spark, d)), "truth_std", "pred_std", "corr", "pred_mean", "truth_mean")


@query("select session, last_idx, round(tx, 6) as dx_true, round(lx, 6) as dx_pred, round(ty, 6) as dy_true, round(ly, 6) as dy_pred from p order by abs(tx) desc, session, last_idx limit 8", v.PREDICTIONS)
def hardest_turns(spark, d):
    return rounded(evaluate.hardest_turns(v.predictions(spark, d)), "dx_true", "dx_pred", "dy_true", "dy_pred")


@query("""select round(m, 6) as mean_lift, provisional, case when m < -0.05 then 'NO RESULT: distribution mismatch' else case when m > 0.03 then 'SIGNAL' else 'FLAT' end
  || case when provisional then ' (provisional)' else '' end end as verdict from (select (select avg(lift) from lf where side = 'holdout') as m,
  count(*) < 20000 or count(distinct session) < 3 as provisional from p)""", _LIFT)
def verdict(spark, d):
    p = v.predictions(spark, d)
    n = p.agg(F.count(F.lit(1)).alias("n")).scalar()
    s = p.agg(F.count_distinct("session").alias("n")).scalar()
    return rounded(evaluate.probe_verdict(evaluate.key_lift(p, _TWO), n, s), "mean_lift")


@query("""select train_windows, holdout_windows, n_sessions, case when holdout_windows = 0 then 'NO GENERALISATION MEASURED' when train_windows < 15000 or n_sessions < 3 then 'PROVISIONAL' else 'COMMITTED' end as verdict
  from (select cast(coalesce(sum(greatest(n_frames - 7, 0)) filter (side = 'train'), 0) as bigint) as train_windows, cast(coalesce(sum(greatest(n_frames - 7, 0)) filter (side = 'holdout'), 0) as bigint) as holdout_windows, count(*) as n_sessions from sd)""", _SPLIT)
def baseline_verdict(spark, d):
    f = v.frames(spark, d).select("session", "frame_idx")
    return evaluate.baseline_verdict(split.split_volume(f, windows.sliding_windows(f, 8), _split(spark, d)))


@query("""select 'press' as event, session, last_idx as frame_idx, key from pe where held and not was union all select 'release', session, last_idx, key from pe where was and not held
  union all select 'release_all', session, last_idx, key from pe where held and last_idx = final""", v.PREDICTIONS + """,
ph as (select session, last_idx, x.key, x.held, max(last_idx) over (partition by session) as final from p, lateral (values ('w', p1 >= 0.5), ('a', p2 >= 0.5)) x(key, held)),
pe as (select *, coalesce(lag(held) over (partition by session, key order by last_idx), false) as was from ph)""")
def policy_keys(spark, d):
    return training.replay_policy(v.predictions(spark, d), _TWO, threshold=0.5)[0]


@query("select session, last_idx as frame_idx, dx, dy from (select *, greatest(-600, least(600, cast(round_even(lx * 2000, 0) as int))) as dx, "
       "greatest(-600, least(600, cast(round_even(ly * 2000, 0) as int))) as dy from p) where dx <> 0 or dy <> 0", v.PREDICTIONS)
def policy_mouse(spark, d):
    scaled = v.predictions(spark, d).withColumn("look_pred", F.transform("look_pred", lambda x: x * 2000))
    return training.replay_policy(scaled, _TWO, threshold=0.5)[1]


@query("select vec_id, round(1 / (1 + exp(-z)), 6) as sigmoid, round((z - 1) / 2, 6) as standardized, round(z * 2 + 1, 6) as inverted from (select vec_id, cast(embedding[1] as double) * 100 as z from embeddings)")
def scalar_functions(spark, d):
    z = (F.get("embedding", F.lit(0)).cast("double") * 100)
    return v.table(spark, d, "embeddings").select("vec_id", z.alias("z")).select(
        "vec_id", F.round(numeric.sigmoid(F.col("z")), 6).alias("sigmoid"),
        F.round(numeric.standardize(F.col("z"), F.lit(1.0), F.lit(2.0)), 6).alias("standardized"),
        F.round(numeric.unstandardize(F.col("z"), F.lit(1.0), F.lit(2.0)), 6).alias("inverted"))


# ---- pixels and models ---------------------------------------------------------

_PIX = """px as (select vec_id, i, cast(floor((x + 1) * 127.5) as int) as b, cast(floor((x + 1) * 60) as int) as g, cast(floor((1 - x) * 100) as int) as r from
  (select vec_id, unnest(range(64)) as i, cast(unnest(embedding) as double) as x from embeddings))"""


@query("select cast(vec_id % 20 as varchar) as session, vec_id as frame_idx, round(var_pop((b + g + r) / 3), 2) as variance from px group by 1, 2", _PIX)
def pixel_variance(spark, d):
    return pixels.radar_variance(v.images(spark, d), ["session", "frame_idx"], hw=(8, 8)).withColumn("variance", F.round("variance", 2))


def _thousandths(x):
    total = F.round(x.cast("double") * 12240)  # 48 bytes of 255 at most
    return F.floor((total * 2000 + 12240) / 24480).cast("int")


@query("""select vec_id as frame_idx, string_agg(cast(cell as varchar), ',' order by c) as cells from (select vec_id, (i // 8) // 4 * 2 + (i % 8) // 4 as c, cast((sum(b + g + r) * 2000 + 12240) // 24480 as int) as cell
  from px group by 1, 2) group by 1""", _PIX)
def pixel_features(spark, d):
    """Cells in thousandths, halves upwards: whole sums of 16 x 3 bytes decide, since fractions put ties on either side."""
    out = pixels.radar_features(v.images(spark, d), ["frame_idx"], hw=(8, 8), size=2)
    return out.select("frame_idx", text(F.transform("features", _thousandths)).alias("cells"))


@query("select cast(vec_id % 20 as varchar) as session, min(least(b, g, r)) as radar_min, max(greatest(b, g, r)) as radar_max, round(sum(b + g + r) / (3 * count(*)), 4) as radar_mean, "
       "max(greatest(b, g, r)) - min(least(b, g, r)) < 5 as radar_flat from px group by 1", _PIX)
def pixel_sample_range(spark, d):
    dense = v.images(spark, d).withColumn("frame_idx", F.floor(F.col("frame_idx") / 20))
    return inspection.pixel_sample(dense, "radar", (8, 8), 1_000_000).withColumn("radar_mean", F.round("radar_mean", 4))


@query("select vec_id as frame_idx, cast(b as bigint) + g + r as top_left_sum, 768 as n_bytes from px where i = 0", _PIX)
def pixel_upscale(spark, d):
    out = pixels.upscale_images(v.images(spark, d), ["frame_idx"], "radar", (8, 8), 2)
    def byte(i):
        return F.conv(F.hex(F.substring("image", i, 1)), 16, 10).cast("long")
    return out.select("frame_idx", (byte(4) + byte(5) + byte(6)).alias("top_left_sum"), F.octet_length("image").alias("n_bytes"))


@query("select cast(i as bigint) as feature, round(avg(x), 6) as mean, round(greatest(stddev_pop(x), 0.01), 6) as std from (select unnest(range(64)) as i, cast(unnest(embedding) as double) as x from embeddings) group by 1")
def feature_scaling(spark, d):
    row = probe.feature_scale(v.table(spark, d, "embeddings"), "embedding")
    return rounded(row.select(F.posexplode(F.arrays_zip("mean", "std")).alias("i", "x")).select(
        F.col("i").cast("long").alias("feature"), "x.mean", "x.std"), "mean", "std")


def _probe_rows(spark, d):
    return v.table(spark, d, "embeddings").select(
        (F.col("vec_id") % 20).cast("string").alias("session"), F.col("vec_id").alias("frame_idx"),
        F.lit(1.0).alias("variance"), F.col("embedding").alias("features"),
        *[(F.col("label") % m == r).cast("int").alias(f"k_{k}") for k, m, r in zip(PROBE_KEYS, (2, 3, 4, 5), (0, 1, 2, 3))])


@query()
def linear_probe(spark, d):
    rows = _probe_rows(spark, d)
    lengths = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n_frames"))
    return training.run_probe(rows, lengths, balanced=True)["lift"]


@query("""select key, count(*) as n, count(*) filter (held) as held, 0.0::double as excess from embeddings, lateral (values
  ('w', label % 2 = 0), ('a', label % 3 = 1), ('s', label % 4 = 2), ('d', label % 5 = 3)) x(key, held) group by 1""")
def probe_optimum(spark, d):
    """At the optimum the intercept's gradient is zero: the mean prediction on TRAIN is the share of frames held."""
    rows = _probe_rows(spark, d)
    lengths = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n_frames"))
    pred = training.run_probe(rows, lengths, balanced=True)["predictions"]
    each = pred.select("side", F.posexplode(F.arrays_zip("probs", "truth")).alias("at", "x"))
    excess = F.avg(F.when(F.col("side") == "train", F.col("x.probs") - F.col("x.truth")))
    return each.groupBy(F.element_at(F.array(*map(F.lit, PROBE_KEYS)), F.col("at") + 1).alias("key")).agg(
        F.count("*").alias("n"), F.count_if(F.col("x.truth") == 1).alias("held"),
        F.abs(F.round(excess, 3)).alias("excess"))


@query()
def movement_baseline(spark, d):
    f = v.frames(spark, d).withColumn("features", F.transform(
        F.concat(actions.action_vector(), F.array(F.col("health").cast("float"))), lambda x: x / 50))
    narrow = f.select("session", "frame_idx", "dx", "dy", "features", *actions.key_columns(MOVEMENT_KEYS))
    return training.run_baseline(narrow, _split(spark, d), length=4, times=2)["lift"]
