"""State updates as a stream: newest state, side output, change and death events."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (BooleanType, IntegerType, StringType, StructField, StructType)

from ..sources.generations import write_generation
from ..sources.state_log import bad_lines, good_updates

EVENT_SCHEMA = ("session STRING, t DOUBLE, n BIGINT, changed ARRAY<STRING>, death BOOLEAN, reason STRING")
_FIELDS = ["has_local_state", "spectating", "health", "alive", "active_weapon", "round_phase", "map_phase"]


def latest_state(updates: DataFrame) -> DataFrame:
    """Newest state and number of updates per session; works on tables and streams.

    Run a stream of it in update mode: state holds one row per session.
    """
    return updates.groupBy("session").agg(
        F.max_by("state", F.struct("t", "n")).alias("state"), F.max("t").alias("state_t"),
        F.count(F.lit(1)).alias("n_updates"))


def split_sinks(updates: DataFrame, good_path: str, bad_path: str) -> DataStreamWriter:
    """Write good updates and unparsable lines to two tables of generations, numbered by batch.

    Start the result with a checkpoint location. A batch that is replayed after a crash
    between the two writes adds to each table only what is not committed there yet.
    """
    return updates.writeStream.foreachBatch(lambda batch, batch_id: store_batch(batch, batch_id, good_path, bad_path))


def store_batch(batch: DataFrame, batch_id: int, good_path: str, bad_path: str) -> None:
    """One batch of ``split_sinks``, for streams with a ``foreachBatch`` of their own."""
    batch.persist()
    write_generation(good_updates(batch), good_path, batch_id)
    write_generation(bad_lines(batch), bad_path, batch_id)
    batch.unpersist()


SLOT_SCHEMA = ("t DOUBLE, n BIGINT, n_updates BIGINT, spectating BOOLEAN, health INT, alive BOOLEAN, "
               "active_weapon STRING, round_phase STRING, map_phase STRING, has_local_state BOOLEAN")
_SLOT_FIELDS = [c.strip().split(" ")[0] for c in SLOT_SCHEMA.split(",")]


# A call of a processor or of its state costs much more than a row, so sessions share hashed groups.
# The number must stay what it was as long as a checkpoint is used.
GROUPS = 256


def group_of(session: str = "session") -> Column:
    """The group whose call handles a session; state is kept by session inside it."""
    return F.pmod(F.xxhash64(session), F.lit(GROUPS)).cast("int")


def _records(batch: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    """Rows as tuples, with None for what is absent."""
    return zip(*[batch[c].astype(object).where(batch[c].notna(), None) for c in columns])


class _Slot(StatefulProcessor):
    """The newest update of a session overwrites its slot; only the number of updates is added up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "session STRING", SLOT_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, seen = {}, Counter()
        fields = [c for c in _SLOT_FIELDS if c != "n_updates"]
        for batch in rows:
            seen.update(batch["session"])
            last = batch.sort_values(["t", "n"], kind="stable").drop_duplicates("session", keep="last")
            for session, *row in _records(last, ["session", *fields]):
                if session not in newest or tuple(row[:2]) >= tuple(newest[session][:2]):
                    newest[session] = row
        changed = []
        for session, row in newest.items():
            held = (dict(zip(_SLOT_FIELDS, self.slots.getValue((session,)))) if self.slots.containsKey((session,))
                    else {"n_updates": 0})
            if held.get("t") is None or (row[0], row[1]) >= (held["t"], held["n"]):
                held |= dict(zip(fields, row))
            held["n_updates"] += seen[session]
            for c in ("n", "health"):
                held[c] = None if held[c] is None else int(held[c])
            for c in ("spectating", "alive", "has_local_state"):
                held[c] = None if held[c] is None else bool(held[c])
            held["t"] = float(held["t"])
            self.slots.updateValue((session,), tuple(held[c] for c in _SLOT_FIELDS))
            changed.append((session, held["n"], held["n_updates"]))
        yield pd.DataFrame(changed, columns=["session", "n", "n_updates"])

    def close(self) -> None:
        pass


def slot_stream(updates: DataFrame) -> DataFrame:
    """Keep the newest update of each session in state; the output says which slots a batch has changed."""
    flat = updates.select("session", "t", "n", *[F.col(f"state.{c}").alias(c) for c in _SLOT_FIELDS[3:]])
    return flat.withColumn("group", group_of()).groupBy("group").transformWithStateInPandas(
        statefulProcessor=_Slot(), outputStructType="session STRING, n BIGINT, n_updates BIGINT",
        outputMode="Update", timeMode="None")


def read_slots(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The slots as of the last committed batch of a ``slot_stream``, read from its state without running it."""
    stored = spark.read.format("statestore").option("stateVarName", "slots").load(checkpoint)
    return stored.select("user_map_key.session", "user_map_value.*")


class _Changes(StatefulProcessor):
    """Compare each update with the last one of its session."""

    _STATE = StructType([
        StructField("spectating", BooleanType()), StructField("health", IntegerType()),
        StructField("alive", BooleanType()), StructField("active_weapon", StringType()),
        StructField("round_phase", StringType()), StructField("map_phase", StringType()),
        StructField("saw_local", BooleanType()), StructField("saw_spectating", BooleanType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "session STRING", self._STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["session", "t", "n"], kind="stable")
        names = [f.name for f in self._STATE]
        out, at, prev = [], None, {}
        for session, t, n, *row in _records(batch, ["session", "t", "n", *_FIELDS]):
            if session != at:
                if at is not None:
                    self.last.updateValue((at,), tuple(prev[c] for c in names))
                held = self.last.getValue((session,)) if self.last.containsKey((session,)) else (None,) * 6 + (False, False)
                at, prev = session, dict(zip(names, held))
            cur = dict(zip(_FIELDS, row))
            if cur["health"] is not None:
                cur["health"] = int(cur["health"])
            changed = []
            if cur["has_local_state"] and not prev["saw_local"]:
                changed.append("local_state")
            if None not in (cur["health"], prev["health"]) and cur["health"] != prev["health"]:
                changed.append("health")
            death = prev["alive"] is True and cur["alive"] is not True
            if death:
                changed.append("death")
            if cur["active_weapon"] != prev["active_weapon"]:
                changed.append("weapon")
            if cur["spectating"] and not prev["saw_spectating"]:
                changed.append("spectating")
            changed += [f for f in ("round_phase", "map_phase") if cur[f] != prev[f]]
            prev = {**cur, "saw_local": bool(prev["saw_local"] or cur["has_local_state"]),
                    "saw_spectating": bool(prev["saw_spectating"] or cur["spectating"])}
            if prev["alive"] is not None:
                prev["alive"] = bool(prev["alive"])
            if changed:
                reason = ("spectating" if cur["spectating"] else "health 0") if death else None
                out.append((session, t, n, changed, death, reason))
        if at is not None:
            self.last.updateValue((at,), tuple(prev[c] for c in names))
        yield pd.DataFrame(out, columns=["session", "t", "n", "changed", "death", "reason"])

    def close(self) -> None:
        pass


def change_stream(updates: DataFrame) -> DataFrame:
    """Change and death events of a stream of good updates, in order of arrival."""
    flat = updates.select("session", "t", "n", *[F.col(f"state.{f}").alias(f) for f in _FIELDS])
    return flat.withColumn("group", group_of()).groupBy("group").transformWithStateInPandas(
        statefulProcessor=_Changes(), outputStructType=EVENT_SCHEMA, outputMode="Append", timeMode="None")
