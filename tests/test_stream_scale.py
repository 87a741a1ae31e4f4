"""Calls for state do not grow with the sessions of a stream, and only the rows asked for are made."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd

from catalog import streams
from replaylens.streaming import frame_stream


class _Map(dict):
    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]

    def containsKey(self, key):
        self.calls += 1
        return key in self


def _recorder():
    maps, timers = {}, []
    handle = SimpleNamespace(getMapState=lambda name, *_: maps.setdefault(name, _Map()), registerTimer=timers.append)
    recorder = frame_stream._Recorder(50, False, 15.0, 1000, 0)
    recorder.init(handle)
    return recorder, maps, timers


def _frames(sessions: int, at: float) -> pd.DataFrame:
    blank = {c: None for c in [*frame_stream.STATE_COLUMNS, "dx", "dy"]}
    return pd.DataFrame([{"session": str(i), "ts": pd.Timestamp(at, unit="s"), "t": at, "kind": 2, "n": i, **blank} for i in range(sessions)])


def test_slots_are_read_by_shelves():
    """A thousand sessions of a group take no more calls than there are shelves, and go on where they were."""
    recorder, maps, timers = _recorder()
    before, after = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10_000)
    assert list(recorder.handleInputRows((0,), iter([_frames(1000, 5.0)]), before)) == []  # no empty tables of late rows
    fired = SimpleNamespace(getExpiryTimeInMs=lambda: timers[0])
    first = pd.concat(recorder.handleExpiredTimer((0,), after, fired))
    assert len(first) == 1000 and set(first["frame_idx"]) == {0}
    later = SimpleNamespace(getCurrentWatermarkInMs=lambda: 20_000)
    list(recorder.handleInputRows((0,), iter([_frames(1000, 15.0)]), after))
    second = pd.concat(recorder.handleExpiredTimer((0,), later, SimpleNamespace(getExpiryTimeInMs=lambda: timers[1])))
    assert len(second) == 1000 and set(second["frame_idx"]) == {1} and set(second["gap"]) == {10.0}
    assert sum(m.calls for m in maps.values()) <= 4 * frame_stream.SHELVES + 20


def test_states_are_parsed_only_when_asked_for(spark, monkeypatch):
    monkeypatch.setattr(streams.v, "states", None)
    rows = streams._rows(spark, "/root/testdata/sf0.001", "frame", "mouse")
    assert {r["kind"] for r in rows.select("kind").distinct().collect()} == {"frame", "mouse"}
