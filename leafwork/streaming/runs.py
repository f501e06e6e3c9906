"""Runs of documents as streaming state: a run is told by its events, in any order within the watermark,
and ends when nothing has been heard of it for long enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafwork.operators.telemetry import ALLOWED, outcome

OUTPUT = "doc_id long, kind string, run int, event_id long, before string, state string, final_state string, n long, illegal long"


class Tracker(StatefulProcessor):
    """One state for each document: events that may still be overtaken, and where its run stands.

    Events wait until the watermark has passed them; then they are taken in order of time and number.
    Each one sets a timer for that, and the run's last event one for the end of its silence. What comes
    behind the watermark is told as late and changes nothing.
    """

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.allowed = handle, set(ALLOWED)
        self.waiting = handle.getMapState("waiting", "at long, event_id long", "state string")
        self.run = handle.getValueState("run", "run int, at long, state string, failed boolean, loaded boolean, n long, illegal long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, late = timerValues.getCurrentWatermarkInMs(), []
        for part in rows:
            for at, event, state in zip(part["at"], part["event_id"], part["state"]):
                if at // 1000 < mark:
                    late.append(self._told(key, "late", None, event, None, state, None, None, None))
                else:
                    self.waiting.updateValue((int(at), int(event)), (state,))
                    self.handle.registerTimer(int(at) // 1000 + 1)
        yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        due = sorted((at, event, value[0]) for (at, event), value in self.waiting.iterator() if at // 1000 < mark)
        run = self.run.get() if self.run.exists() else None
        for at, event, state in due:
            self.waiting.removeKey((at, event))
            if run is not None and run[5] and at - run[1] > 1000 * self.silence:
                out.append(self._ended(key, run))
                run = (run[0] + 1, at, None, False, False, 0, 0)
            number, _, before, failed, loaded, n, illegal = run or (0, at, None, False, False, 0, 0)
            if None not in (before, state) and before != state and (before, state) not in self.allowed:
                out.append(self._told(key, "violation", number, event, before, state, None, None, None))
                illegal += 1
            run = (number, at, state, failed or state == "FAILED", loaded or state == "LOADED", n + 1, illegal)
        if run is not None and run[5]:
            quiet = run[1] // 1000 + self.silence + 1
            if quiet < mark and not any(True for _ in self.waiting.keys()):
                out.append(self._ended(key, run))
                run = (run[0] + 1, run[1], None, False, False, 0, 0)  # its number stays known
            else:
                self.handle.registerTimer(max(quiet + 1, mark + 1))
        if run is not None:
            self.run.update(run)
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _ended(self, key, run) -> tuple:
        return self._told(key, "ended", run[0], None, None, run[2], outcome(run[3], run[4]), run[5], run[6])

    @staticmethod
    def _told(key, *values) -> tuple:
        return (key[0], *values)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        f = pd.DataFrame(rows, columns=names)
        return f.astype({"doc_id": "int64", "run": "Int32", "event_id": "Int64", "n": "Int64", "illegal": "Int64"})


def tracked(states: DataFrame, late: str = "10 minutes", silence_minutes: int = 60) -> DataFrame:
    """A stream of states (doc_id, event_id, ts, state) as one of what they tell, by kind: "violation", an
    event whose state may not follow the one before in its run; "ended", a run that has been silent for
    so long, with its outcome, number of events and of violations; "late", an event behind the
    watermark. Events without document, number or time are left out. The session needs the RocksDB state store."""
    e = states.where("doc_id is not null and event_id is not null and ts is not null").withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    # the time goes on as a number: rows whose time is marked as such would be dropped unseen if late
    slim = e.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros("_at").alias("at"), "state")
    return slim.groupBy("doc_id").transformWithStateInPandas(Tracker(silence_minutes * 60_000), OUTPUT, "Append", "EventTime")
