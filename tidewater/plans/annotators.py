"""Annotators: named, versioned steps that write one uniform table of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.joins import concat
from ..streaming.limits import prepare

UNAVAILABLE = ("not_configured", "budget_exhausted", "error")


@dataclass(frozen=True)
class Annotator:
    """`run` maps the events it applies to onto (event_id, status, output, confidence); output is JSON text.

    `each` does so for one event at a time, from a dict of its columns to a dict of status, output and confidence. An event
    that it fails on is unavailable by itself, and the others have their results.
    """

    name: str
    version: str
    applies: Column
    run: Callable[[DataFrame], DataFrame] | None = None
    #: Why it can't run, where it has neither.
    unavailable: str = "not_configured"
    each: Callable[[dict[str, Any]], dict[str, Any]] | None = None


def one_by_one(events: DataFrame, each: Callable[[dict[str, Any]], dict[str, Any]]) -> DataFrame:
    """(event_id, status, output, confidence): each over every event; status is null where it raised or gave no such row."""
    prepare(events)
    out = StructType([StructField("event_id", events.schema["event_id"].dataType), StructField("status", StringType()), StructField("output", StringType()), StructField("confidence", IntegerType())])
    types = {"status": pa.string(), "output": pa.string(), "confidence": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said: dict[str, list] = {c: [] for c in types}
            for row in b.to_pylist():
                try:
                    got = each(row)
                    values = {c: pa.scalar(got.get(c), t).as_py() for c, t in types.items()}
                except Exception:  # whatever a step raises is that event's alone
                    values = dict.fromkeys(types)
                for c in types:
                    said[c].append(values[c])
            yield pa.RecordBatch.from_arrays([b.column("event_id"), *[pa.array(said[c], t) for c, t in types.items()]], names=["event_id", *types])

    return events.mapInArrow(run, out)


def run_annotators(events: DataFrame, annotators: list[Annotator], at: Column) -> DataFrame:
    """(event_id, agent, version, status, reason, output, confidence, at): a row for each event and annotator that applies.

    An event for which an annotator gives no row, and an annotator without a run, count as unavailable.
    """
    parts = []
    for a in annotators:
        mine = events.filter(F.coalesce(a.applies, F.lit(False)))
        head = [F.lit(a.name).alias("agent"), F.lit(a.version).alias("version")]
        if a.each is not None:
            rows, why = one_by_one(mine, a.each), "error"
        elif a.run is None:
            rows = mine.select("event_id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("output"), F.lit(None).cast("int").alias("confidence"))
            why = a.unavailable
        else:
            rows = mine.select("event_id").join(a.run(mine).select("event_id", "status", "output", F.col("confidence").cast("int").alias("confidence")), "event_id", "left")
            why = "error"
        missing = F.col("status").isNull()
        parts.append(rows.select("event_id", *head, F.coalesce("status", F.lit("unavailable")).alias("status"), F.when(missing, why).alias("reason"), "output", "confidence", at.alias("at")))
    return concat(parts)


def failures(runs: DataFrame) -> DataFrame:
    """Events whose runs failed or whose output was rejected; what isn't configured is no failure."""
    bad = (F.col("status") == "blocked") | ((F.col("status") == "unavailable") & (F.col("reason") == "error"))
    return runs.filter(bad).select("event_id").distinct()
