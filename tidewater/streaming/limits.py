"""Fixed-window rate limits and lockouts, over tables and over streams."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepare(df: DataFrame) -> None:
    """Lets Python workers import this package where it isn't installed."""
    root, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def window_step(state: tuple[int, int] | None, micros: int, limit: int, seconds: int) -> tuple[tuple[int, int], bool]:
    """The state (window start, requests) after a request, and whether it is over the limit."""
    if state is None or micros - state[0] >= seconds * 1_000_000:
        state = (micros, 0)
    state = (state[0], state[1] + 1)
    return state, state[1] > limit


def lockout_step(state: tuple[int, int] | None, micros: int, ok: bool, failures: int, seconds: int) -> tuple[tuple[int, int], bool]:
    """The state (failures in a row, locked until) after an attempt, and whether the attempt met a lock."""
    fails, until = state or (0, 0)
    if micros < until:
        return (fails, until), True
    if ok:
        return (0, 0), False
    fails += 1
    return ((0, micros + seconds * 1_000_000) if fails >= failures else (fails, 0)), False


def _walk(df: DataFrame, key: list[str], at: str, tie: str, extra: str | None, step: Callable) -> DataFrame:
    """df's rows for which step(state, micros, extra) says so; a key's rows are walked in order, one row's state at a time."""
    prepare(df)
    k = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key])
    rows = df.withColumns({"_k": k, "_m": F.unix_micros(F.col(at).cast("timestamp")), "_x": F.col(extra) if extra else F.lit(None).cast("boolean")})
    rows = rows.repartition("_k").sortWithinPartitions("_k", "_m", tie)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for b in batches:
            keep = []
            for k_, m, x in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_k", "_m", "_x"))):
                if k_ != current:
                    current, state = k_, None
                state, hit = step(state, m, x)
                keep.append(hit)
            if any(keep):
                yield b.select(names).filter(pa.array(keep))

    return rows.mapInArrow(run, df.schema)


def walk_windows(requests: DataFrame, limit: int, seconds: int, key: list[str], at: str = "at", tie: str = "id") -> DataFrame:
    """Requests over `limit` in a window of `seconds` that the key's first request opened."""
    return _walk(requests, key, at, tie, None, lambda s, m, _: window_step(s, m, limit, seconds))


def walk_lockouts(attempts: DataFrame, failures: int = 5, seconds: int = 900, key: str = "user_id", at: str = "at", tie: str = "id", ok: str = "ok") -> DataFrame:
    """Attempts that met a lock, set by so many failures in a row."""
    return _walk(attempts, [key], at, tie, ok, lambda s, m, x: lockout_step(s, m, bool(x), failures, seconds))


HITS = "key string, id long, micros long"


def _hits(df: DataFrame, key: str, at: str, tie: str, extra: str | None, delay: str, step: Callable, until: Callable) -> DataFrame:
    """(key, id, micros) of rows for which step(state, micros, extra) says so, as the watermark passes them."""
    from .ordered import Walk, in_order, keyed

    def judged(k: str, state: tuple, row: tuple) -> tuple:
        state, hit = step(state, row[0], bool(row[2]))
        return state, (k, row[1], row[0]) if hit else None

    walk = Walk("a long, b long", lambda s: s, judged, lambda s: s, lambda s: until(s) if s else 0)
    return in_order(keyed(df, key, at, tie, ok=F.col(extra) if extra else F.lit(True)), "at", walk, HITS, delay)


def rate_limited_stream(requests: DataFrame, limit: int, seconds: int, key: str, at: str = "at", tie: str = "id", delay: str = "1 hour") -> DataFrame:
    """As walk_windows, over a stream: (key, id, micros) of requests over the limit, in whatever order they come within the delay."""
    return _hits(requests, key, at, tie, None, delay, lambda s, m, _: window_step(s, m, limit, seconds), lambda s: s[0] + seconds * 1_000_000)


def lockouts_stream(attempts: DataFrame, failures: int = 5, seconds: int = 900, key: str = "user_id", at: str = "at", tie: str = "id", ok: str = "ok", delay: str = "1 hour") -> DataFrame:
    """As walk_lockouts, over a stream; failures are remembered until a success or a lock, however long that takes."""
    return _hits(attempts, key, at, tie, ok, delay, lambda s, m, x: lockout_step(s, m, x, failures, seconds), lambda s: s[1] if s[0] == 0 else None)
