"""Registered streaming queries: the events replayed as a stream, run to the end.

Rows arrive in steps, one trigger each. Most come in the order of time or nearly so; what
is said to be late comes some steps after its time has been released.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replaylens.session import shared_folder, written
from replaylens.sources.generations import read_all
from replaylens.sources.state_log import parse_lines
from replaylens.streaming import frame_stream, metrics, state_stream
from replaylens.streaming.frame_stream import record_stream, recording_input
from replaylens.streaming.state_stream import change_stream

from . import views as v
from .queries import _LAST, _MOUSE, FPS, query

_LINE = "session STRING, t DOUBLE, kind STRING, n BIGINT, value STRING, dx INT, dy INT"
STEPS, FILES = 4, 4

# The step of an event, in both engines: the same number of events each, in the order of time.
_STEP = f"least({STEPS - 1}, cast(floor(({{n}} - lo) * {STEPS}.0 / (hi - lo + 1)) as int))"
_SPAN = "span as (select min(event_id) as lo, max(event_id) as hi, epoch_us(min(ts)) / 1e6 as t0, epoch_us(max(ts)) / 1e6 as t1 from events)"
_LATE = "case when n % 13 = 0 then 2 else 0 end"


def _steps(spark: SparkSession, d: str, rows: DataFrame, shift: str = "0") -> DataFrame:
    """Add the step in which each row comes, and write the rows once: steps are picked from this table."""
    span = v.table(spark, d, "events").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    step = _STEP.format(n="n")
    return written(rows.withColumns({c: span.select(c).scalar() for c in ("lo", "hi")}).withColumn(
        "step", F.expr(f"{step} + {shift}")).drop("lo", "hi"), "replay")


def _replay(spark: SparkSession, steps: DataFrame, end: bool = True) -> tuple[DataFrame, str]:
    """A stream over a drop folder that gets ``FILES`` files for each step, oldest first.

    Files of a step are dealt by a hash of n, so no task gets a whole step. With ``end``,
    one far-future row follows: the last rows of a stream are released once the watermark has passed them.
    """
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    columns = [c.split(" ")[0] for c in _LINE.split(", ")]
    last = steps.agg(F.max("step")).first()[0] or 0
    for step in range(last + 1):
        steps.where(F.col("step") == step).select(*columns).repartition(FILES, "n").write.mode("append").parquet(f"{folder}/in")
    if end:
        final = steps.agg((F.max("t") + 100 * 86400).alias("t")).select(
            F.lit("~end").alias("session"), "t", F.lit("frame").alias("kind"), F.lit(-1).cast("long").alias("n"),
            F.lit(None).cast("string").alias("value"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))
        final.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(_LINE).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in"), folder


def _run(out: DataFrame, folder: str) -> DataFrame:
    spark = out.sparkSession
    q = (out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/cp")
         .trigger(availableNow=True).start(f"{folder}/out"))
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").where("session <> '~end'")


def _run_with_crash(writer, folder: str, batch_id: int) -> None:
    """Run a ``foreachBatch`` writer to the end, with one crash after a batch's rows were stored.

    Spark has not noted that batch as done, so the restarted query replays it.
    """
    def start():
        q = writer.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    try:
        start()
        raise AssertionError(f"batch {batch_id} was never reached")
    except Exception as e:
        if "crash after the write" not in str(e):
            raise
    start()


def _crashing(write: Callable, batch_id: int) -> Callable:
    left = [batch_id]

    def once(batch: DataFrame, number: int) -> None:
        write(batch, number)
        if left and number == left[0]:
            left.clear()
            raise RuntimeError("crash after the write")
    return once


def _rows(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Rows of the given kinds; the JSON of state updates is parsed only where they are among them."""
    def pad(df, kind):
        have = df.columns
        return df.select("session", "t", F.lit(kind).alias("kind"), F.col("n").cast("long").alias("n"),
                         (F.col("value") if "value" in have else F.lit(None)).cast("string").alias("value"),
                         *[(F.col(c) if c in have else F.lit(0)).cast("int").alias(c) for c in ("dx", "dy")])
    sources = {"frame": lambda: v.plain_frames(spark, d), "mouse": lambda: v.mouse_events(spark, d),
               "state": lambda: v.states(spark, d).withColumn("value", F.to_json("state"))}
    return reduce(DataFrame.unionByName, [pad(sources[kind](), kind) for kind in kinds or sources])


def _typed(spark: SparkSession, d: str, lines: DataFrame) -> DataFrame:
    schema = v.updates(spark, d).schema["state"].dataType
    return lines.withColumn("state", F.from_json("value", schema))


def _recording(spark: SparkSession, d: str, stream: DataFrame) -> DataFrame:
    typed = _typed(spark, d, stream)

    def part(kind):
        return typed.where(F.col("kind") == kind)
    return recording_input(part("frame"), part("state"), part("mouse"))


def _days(spark: SparkSession, d: str, share: float) -> tuple[str, float]:
    """A share of the time that the events span, as an interval and in seconds."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    micros = v.table(spark, d, "events").agg((F.max(ts) - F.min(ts)).alias("us")).first()[0]
    seconds = max(1, int(micros * share / 1e6))
    return f"{seconds} seconds", seconds


@query("select session, n, substr(changed, 2) as changed, died as death from ch where changed <> ''", _LAST)
def stream_changes(spark, d):
    stream, folder = _replay(spark, _steps(spark, d, _rows(spark, d, "state")), end=False)
    updates = _typed(spark, d, stream).select("session", "t", "n", "state")
    return _run(change_stream(updates), folder).select("session", "n", F.array_join("changed", ",").alias("changed"), "death")


# Every third row comes a step after its time, which a delay of two steps takes in.
_MIXED = "case when n % 3 = 0 then 1 else 0 end"


@query("""select pf.session, pf.event_id as n, row_number() over (partition by pf.session order by pf.t) - 1 as frame_idx, round(pf.t - st.t, 6) as state_age,
  case when coalesce(st.alive, false) then 1 else 0 end as alive, coalesce(st.health, 0) as health, cast(coalesce(h.dx, 0) as bigint) as dx, cast(coalesce(h.n, 0) as bigint) as n_events
  from pf asof left join st on pf.session = st.session and pf.t >= st.t
  left join (select session, frame_idx, sum(dx) as dx, count(*) as n from hit group by 1, 2) h on h.session = pf.session and h.frame_idx = pf.event_id""",
       v.STATES + ",\n" + _MOUSE.split(",\n", 2)[2])
def stream_frames(spark, d):
    stream, folder = _replay(spark, _steps(spark, d, _rows(spark, d), _MIXED))
    delay, seconds = _days(spark, d, 2.1 / STEPS)
    out = record_stream(_recording(spark, d, stream), delay, require_contact=False, slice_seconds=seconds / 20)
    return _run(out, folder).select("session", "n", "frame_idx", F.round("state_age", 6).alias("state_age"),
                                    "alive", "health", "dx", "n_events")


_ARRIVED = _SPAN + f""",
r as (select cast(user_id as varchar) as session, event_id as n, epoch_us(ts) / 1e6 as t, event_type, t1 - t0 as whole,
      {_STEP.format(n="event_id")} + {_LATE.replace("n %", "event_id %")} as step from events, span),
w as (select step, max(max(t)) over (order by step rows between unbounded preceding and 1 preceding) as seen from r group by 1)"""


@query(f"""select session, n, kind from (select r.*, unnest(case when r.event_type in ('error', 'purchase') then
  case when cast(json_extract_string(e.props, '$.k') as int) % 17 = 0 then ['mouse'] else ['state', 'mouse'] end else ['frame'] end) as kind, seen
  from r join w using (step) join events e on e.event_id = r.n) where t < seen - floor(whole * {0.5 / STEPS})""", _ARRIVED)
def stream_late_rows(spark, d):
    """Rows that come two steps after their time, where half a step is waited for."""
    stream, folder = _replay(spark, _steps(spark, d, _rows(spark, d), _LATE))
    delay, seconds = _days(spark, d, 0.5 / STEPS)
    out = record_stream(_recording(spark, d, stream), delay, require_contact=False, slice_seconds=seconds / 20,
                        late_for=_days(spark, d, 1.0)[0])
    return frame_stream.late_rows(_run(out, folder)).select("session", "n", "kind")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """State lines as they arrive, those that are not JSON too; n is the event's."""
    lines = v.state_lines(spark, d)
    n = F.coalesce(F.get_json_object("value", "$.n"), F.regexp_extract("value", r"(\d+)$", 1)).cast("long")
    return lines.select("session", F.lit(0.0).alias("t"), F.lit("line").alias("kind"), n.alias("n"), "value",
                        F.lit(0).alias("dx"), F.lit(0).alias("dy"))


@query("""select session, case when k % 17 = 0 then 'not json ' || event_id end as bad_line,
  case when k % 17 <> 0 then event_id end as n from e where event_type in ('error', 'purchase')""", v.EVENTS)
def stream_bad_lines(spark, d):
    """Good and bad lines in two tables, once each, although a batch is replayed after a crash."""
    stream, folder = _replay(spark, _steps(spark, d, _log(spark, d)), end=False)
    updates = parse_lines(stream.select("session", "value"), v.TOKEN)
    good, bad = f"{folder}/good", f"{folder}/bad"

    def write(batch, number):
        state_stream.store_batch(batch, number, good, bad)
    _run_with_crash(updates.writeStream.foreachBatch(_crashing(write, 2)), folder, 2)
    lines = read_all(spark, bad, "session STRING, bad_line STRING").select(
        "session", "bad_line", F.lit(None).cast("long").alias("n"))
    return read_all(spark, good, "session STRING, n LONG").select(
        "session", F.lit(None).cast("string").alias("bad_line"), "n").unionByName(lines)


@query("""select session, arg_max(n, t) as n, count(*) as n_updates, arg_max(coalesce(health, -1), t) as health,
  arg_max(spectating, t) as spectating from st group by 1""", v.STATES)
def stream_latest_slot(spark, d):
    """The slot of each session read from the stream's state, after a stop and a restart in the middle."""
    steps = _steps(spark, d, _rows(spark, d, "state"))
    stream, folder = _replay(spark, steps.where(f"step < {STEPS // 2}"), end=False)
    updates = _typed(spark, d, stream).select("session", "t", "n", "state")

    def run():
        q = (state_stream.slot_stream(updates).writeStream.format("noop").outputMode("update")
             .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
        q.awaitTermination()
    run()
    columns = [c.split(" ")[0] for c in _LINE.split(", ")]
    for step in range(STEPS // 2, STEPS):
        steps.where(F.col("step") == step).select(*columns).repartition(FILES, "n").write.mode("append").parquet(f"{folder}/in")
    run()
    return state_stream.read_slots(spark, f"{folder}/cp").select(
        "session", "n", "n_updates", F.coalesce("health", F.lit(-1)).alias("health"), "spectating")


_INDEXED = """
x as (select session, event_id as n, row_number() over (partition by session order by t) - 1 as frame_idx,
      t - lag(t) over (partition by session order by t) as gap from pf)"""


@query("select session, n, frame_idx, cast(frame_idx // 50 as int) as chunk_idx from x", v.PLAIN + "," + _INDEXED)
def stream_chunks(spark, d):
    """Frames appended chunk by chunk, with a replayed batch, merged and then read."""
    rows = v.plain_frames(spark, d).select(
        "session", "t", F.lit("frame").alias("kind"), F.col("n").cast("long").alias("n"),
        F.lit(None).cast("string").alias("value"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    stream, folder = _replay(spark, _steps(spark, d, rows, _MIXED))
    delay, seconds = _days(spark, d, 2.1 / STEPS)
    out = record_stream(_recording(spark, d, stream), delay, 50, require_contact=False, slice_seconds=seconds / 20)
    path = f"{folder}/chunks"
    _run_with_crash(out.writeStream.foreachBatch(_crashing(
        lambda batch, number: frame_stream.store_chunks(batch, number, path), 3)), folder, 3)
    frame_stream.compact_chunks(spark, path)
    return frame_stream.read_chunks(spark, path).where("session <> '~end'").select("session", "n", "frame_idx", "chunk_idx")


@query(f"""select count(*) as frames, count(*) filter (where gap > 1.8 / {FPS}) as long_gaps,
  round(count(gap) / sum(gap), 9) as fps from x""", v.PLAIN + "," + _INDEXED)
def stream_metrics(spark, d):
    """Frames, long gaps and rate of a stream, from the table that a listener stored batch by batch."""
    stream, folder = _replay(spark, _steps(spark, d, _rows(spark, d, "frame"), _MIXED))
    delay, seconds = _days(spark, d, 2.1 / STEPS)
    out = record_stream(_recording(spark, d, stream), delay, require_contact=False, slice_seconds=seconds / 20)
    listener = metrics.StoredMetrics(spark, f"{folder}/metrics")
    spark.streams.addListener(listener)
    try:
        observed = frame_stream.with_metrics(out.where("session <> '~end'"), FPS)
        q = (observed.writeStream.format("noop").option("checkpointLocation", f"{folder}/cp")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        if not listener.ended(q.runId):
            raise TimeoutError("the stream's last metrics did not arrive")
    finally:
        spark.streams.removeListener(listener)
    return metrics.running_totals(metrics.read_metrics(spark, f"{folder}/metrics")).select(
        "frames", "long_gaps", F.round("fps", 9).alias("fps"))
