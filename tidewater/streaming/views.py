"""View admission (T5): automated clients, then the cool-down, then the hourly limit; rejected rows stay with a reason."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import cooldown, hourly_rate
from .ordered import Walk, in_order, keyed


def admit_views(views: DataFrame, bot: Column, minutes: float = 30, limit: int = 60, hours: float = 1, at: str = "at", tie: str = "id") -> DataFrame:
    """views (event_id, session, at, id) with `counted` and `reason`.

    Rejected rows count as recent too, so each decision depends on the rows before only: two windows, no loop.
    """
    reason = F.when(bot, "bot_pattern").when(cooldown(views, ["session", "event_id"], minutes, at, tie), "dedupe_window").when(hourly_rate("session", limit, hours, at), "rate_limit")
    return views.withColumn("reason", reason).withColumn("counted", F.col("reason").isNull())


ADMITTED = "session string, id long, event_id string, micros long, reason string"


def admit_views_stream(views: DataFrame, minutes: float = 30, limit: int = 60, hours: float = 1, at: str = "at", tie: str = "id", delay: str = "1 hour") -> DataFrame:
    """The same over a stream of (event_id, session, at, id, is_bot), keyed by session, in whatever order rows come within the delay.

    State keeps times in reach only.
    """
    reach, window = int(minutes * 60_000_000), int(hours * 3_600_000_000)

    def load(stored: tuple | None) -> tuple[dict, deque]:
        events, at_, times = stored or ([], [], [])
        return dict(zip(events, at_)), deque(times)

    def step(session: str, state: tuple[dict, deque], row: tuple) -> tuple[tuple[dict, deque], tuple]:
        (last, times), (m, i, event, bot) = state, row
        while times and times[0] <= m - window:
            times.popleft()
        recent = bisect_left(times, m)  # those at the same time don't count
        reason = "bot_pattern" if bot else "dedupe_window" if event in last and m - last[event] < reach else "rate_limit" if recent >= limit else None
        last[event] = m
        times.append(m)
        return state, (session, i, event, m, reason)

    def dump(state: tuple[dict, deque]) -> tuple[list, list, list]:
        last, times = state
        newest = times[-1] if times else 0
        kept = {e: t for e, t in last.items() if newest - t < reach}
        return list(kept), list(kept.values()), list(times)

    walk = Walk("events array<string>, event_times array<long>, times array<long>", load, step, dump, lambda s: s[1][-1] + max(reach, window) if s[1] else 0)
    rows = keyed(views, "session", at, tie, event_id=F.col("event_id").cast("string"), bot=F.coalesce("is_bot", F.lit(False)))
    return in_order(rows, "at", walk, ADMITTED, delay)
