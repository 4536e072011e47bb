"""Streams whose state outlives a batch and a restart: undo stacks and generations.

The state of a user lies in Spark's state store, as values and lists. Rows of a batch are applied in
order of time; a stream must bring batches in that order, as files of a folder come. A user
without events for ``idle`` loses what could be undone, by a timer on event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagequarry.streaming.replay import undo_step

UNDO = "user_id long, can_undo long, can_redo long, top long, generation long, closed boolean"
FRESH = "user_id long, event_id long, generation long"
ORDER = ["ts", "event_id"]


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = [r for r in rows if len(r)]
    return pd.concat(parts).sort_values(ORDER, kind="stable") if parts else pd.DataFrame(columns=ORDER)


class UndoStacks(StatefulProcessor):
    """Two stacks and a generation a user: every edit, undo and redo makes a new generation."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getListState("done", "event_id long")
        self.undone = handle.getListState("undone", "event_id long")
        self.generation = handle.getValueState("generation", "n long, timer long")

    def _stacks(self) -> tuple[list[int], list[int]]:
        return [x[0] for x in self.done.get()], [x[0] for x in self.undone.get()]

    def _put(self, stacks: tuple[list[int], list[int]]) -> None:
        for state, stack in zip((self.done, self.undone), stacks, strict=True):
            if stack:
                state.put([(int(x),) for x in stack])
            else:
                state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        batch = _in_order(rows)
        if not len(batch):
            return
        stacks = self._stacks()
        generation, timer = self.generation.get() if self.generation.exists() else (0, 0)
        for event_id, kind in zip(batch["event_id"].tolist(), batch["kind"].tolist(), strict=True):
            stacks = undo_step(stacks, event_id, kind)
        generation += len(batch)
        if self.idle_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = int(batch["ts"].max().timestamp() * 1000) + self.idle_ms
            self.handle.registerTimer(timer)
        self._put(stacks)
        self.generation.update((generation, timer))
        done, undone = stacks
        yield pd.DataFrame({"user_id": [key[0]], "can_undo": [len(done)], "can_redo": [len(undone)], "top": pd.array([done[-1] if done else None], "Int64"), "generation": [generation], "closed": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        generation, _ = self.generation.get()
        self._put(([], []))
        self.generation.update((generation, 0))
        yield pd.DataFrame({"user_id": [key[0]], "can_undo": [0], "can_redo": [0], "top": pd.array([None], "Int64"), "generation": [generation], "closed": [True]})

    def close(self) -> None:
        pass


class FreshResults(StatefulProcessor):
    """Results that are not older than the newest generation that their user has asked for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "generation long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _in_order(rows)
        if not len(batch):
            return
        before = self.newest.get()[0] if self.newest.exists() else -1
        newest = batch["generation"].cummax().clip(lower=before)
        self.newest.update((int(newest.iloc[-1]),))
        yield batch[batch["generation"] >= newest][["user_id", "event_id", "generation"]]

    def close(self) -> None:
        pass


def undo_stream(events: DataFrame, idle_ms: int = 0, late: str = "0 seconds") -> DataFrame:
    """Undo depths of each user after every batch of ``user_id, event_id, ts, kind`` (do, undo, redo)."""
    rows = events.select("user_id", "event_id", "ts", "kind").withWatermark("ts", late) if idle_ms else events.select("user_id", "event_id", "ts", "kind")
    return rows.groupBy("user_id").transformWithStateInPandas(UndoStacks(idle_ms), UNDO, "Update", "EventTime" if idle_ms else "None")


def fresh_stream(results: DataFrame) -> DataFrame:
    """Results (``user_id, event_id, ts, generation``) that no newer generation has overtaken."""
    return results.select("user_id", "event_id", "ts", F.col("generation").cast("long").alias("generation")).groupBy("user_id").transformWithStateInPandas(FreshResults(), FRESH, "Update", "None")
