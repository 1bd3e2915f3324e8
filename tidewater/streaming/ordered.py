"""Keyed streams in event-time order: rows wait in list state until the watermark passes their time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .limits import prepare

#: State stores that keep list state and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Walk:
    """How a key's rows are judged one after the other. Rows start with (micros, id), which order them.

    load makes the walk's state of what was stored (None at first), step takes (key, state, row) to the new state and
    an output row or None, dump gives what to store, and until the microseconds of event time from which on the state
    no longer matters (None if it matters until it changes).
    """

    stored: str
    load: Callable[[tuple | None], Any]
    step: Callable[[str, Any, tuple], tuple[Any, tuple | None]]
    dump: Callable[[Any], tuple]
    until: Callable[[Any], int | None]


class _InOrder(StatefulProcessor):
    """A reorder buffer: one timer a key, for its earliest waiting row or for the end of its state."""

    def __init__(self, walk: Walk, types: dict[str, StructType], columns: list[str], out: list[str]):
        self.walk, self.types, self.columns, self.out = walk, types, columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.types["waiting"])
        self.state = handle.getValueState("state", self.types["state"])
        self.timer = handle.getValueState("timer", self.types["timer"])

    def _wake_at(self, ms: int | None, earlier_only: bool = False) -> None:
        """Moves the key's timer; with earlier_only, not to a later time."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is not None:
            if ms == now or (earlier_only and ms > now):
                return
            self.handle.deleteTimer(now)
        if ms is None:
            self.timer.clear()
            return
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            # nulls of numbers come as NaN
            values = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in frame[self.columns].itertuples(index=False, name=None)]
            self.waiting.appendList(values)
            first = min(v[0] for v in values)
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake_at(-(-earliest // 1000), earlier_only=True)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for r in self.waiting.get():
            (due if r[0] <= passed else later).append(tuple(r))
        due.sort(key=lambda r: r[:2])
        # state that no longer matters to what is still to come gives the same as none
        state, said = self.walk.load(tuple(self.state.get()) if self.state.exists() else None), []
        for r in due:
            state, row = self.walk.step(key[0], state, r)
            if row is not None:
                said.append(row)
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        end = self.walk.until(state)
        if end is not None and end <= passed:
            self.state.clear()
            end = None
        else:
            self.state.update(self.walk.dump(state))
        wake = [-(-x // 1000) for x in (min((r[0] for r in later), default=None), end) if x is not None]
        self._wake_at(min(wake) if wake else None)
        yield pd.DataFrame(said, columns=self.out)


def in_order(rows: DataFrame, at: str, walk: Walk, out: str, delay: str) -> DataFrame:
    """walk over a stream of (key string, micros long, id long, ..., `at`), each key's rows in the order of (micros, id).

    However rows are dealt over micro-batches, the results are those of one sorted pass, as long as no row comes later
    than `delay` behind the newest; Spark leaves out those that do. A row's result comes once the watermark has passed
    its time. A key's rows of one delay are held by one task at a time, and its state for as long as it matters.
    """
    prepare(rows)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # read when the stream starts
    columns = [c for c in rows.columns if c not in ("key", at)]
    types = {"waiting": rows.select(columns).schema, "state": StructType.fromDDL(walk.stored), "timer": StructType.fromDDL("ms long")}
    processor = _InOrder(walk, types, columns, StructType.fromDDL(out).names)
    return rows.withWatermark(at, delay).groupBy("key").transformWithStateInPandas(processor, out, "append", "eventTime")


def keyed(df: DataFrame, key: str, at: str, tie: str, **more: Any) -> DataFrame:
    """Rows for in_order: a null key is a key of its own, rows without a time or number take no part."""
    rows = df.filter(F.col(at).isNotNull() & F.col(tie).isNotNull())
    return rows.select(F.coalesce(F.col(key).cast("string"), F.lit("\x00")).alias("key"), F.unix_micros(F.col(at)).alias("micros"), F.col(tie).cast("long").alias("id"), F.col(at).alias("at"), *[c.alias(n) for n, c in more.items()])
