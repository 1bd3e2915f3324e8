"""Micro-batch cycle (T1-T4, T6-T8, T11, T12), and a job of stages that each take a batch once."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.measures import hours_between
from ..functions.text import article_id
from ..operators.joins import needs_review, not_notified
from ..sources.feeds import extract_feed_geo, extract_measurements, parse_feed, read_feed_bodies
from ..sources.stored import StoredTable, append_once, exists, read_ledger


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "10 minutes") -> StreamingQuery:
    """Runs `batch` on each micro-batch, by a period or once over what is there (every=None)."""
    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def capped(spark: SparkSession, path: str, schema: str, files: int) -> DataFrame:
    """A stream of Parquet files, at most so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def new_items(stream: DataFrame, at: str = "published_at", delay: str = "48 hours", link: str = "link") -> DataFrame:
    """Items with their article id, each id once within the watermark."""
    return stream.withColumn("article_id", article_id(F.col(link))).withWatermark(at, delay).dropDuplicatesWithinWatermark(["article_id"])


def landed_items(spark: SparkSession, landing: str, ledger: str, as_of: Column, files: int = 64, delay: str = "48 hours") -> DataFrame:
    """Items of all feed files in a landing folder, each once: a stream over what is there, kept batch by batch in `ledger`.

    A micro-batch takes at most `files` files. The stream's checkpoint lies beside the ledger, so a run that dies goes on
    where it stopped, a batch that is run again stands once, and a later run takes only files that arrived since. Items
    that lie further back than `delay` behind the newest are late and left out.
    """
    stream = read_feed_bodies(spark, landing, stream=True, files=files)
    items = new_items(extract_measurements(extract_feed_geo(parse_feed(stream, as_of))), delay=delay)
    run(items, lambda df, n: append_once(df, ledger, n), f"{ledger}-checkpoint", every=None).awaitTermination()
    return read_ledger(spark, ledger, items.schema)


def changed_events(events: DataFrame, reviews: DataFrame, n: int = 400) -> DataFrame:
    """The next events to analyse: active since their last review, newest first."""
    return needs_review(events, reviews).orderBy(F.desc_nulls_last("last_activity_at"), "event_id").limit(n)


def late_articles(stream: DataFrame, at: str = "published_at", hours: int = 48) -> DataFrame:
    return stream.withWatermark(at, f"{hours} hours")


def may_join(article_at: Column, last_activity_at: Column, hours: float = 48) -> Column:
    """An article may join any event active after its time less `hours`, however much newer the event is."""
    return hours_between(last_activity_at, article_at) > -hours


def windowed(stream: DataFrame, at: str, length: str, keys: list[str], delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, delay).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def notify_once(matches: DataFrame, notifications: DataFrame) -> DataFrame:
    """New matches, each (user, rule, event) once."""
    return not_notified(matches.dropDuplicates(["user_id", "rule_id", "event_id"]), notifications)


def due(control: DataFrame, job: str, as_of: Column, hours: float = 24) -> DataFrame:
    """One row with `due`: whether the job's last run (job, last_run) lies so far back, or it never ran."""
    last = control.filter(F.col("job") == job).agg(F.max("last_run").alias("last_run"))
    return last.select(F.coalesce(hours_between(as_of, F.col("last_run")) >= hours, F.lit(True)).alias("due"))


@dataclass(frozen=True)
class Stage:
    """A step of a job. work(rows, batch) writes what belongs to the batch under its number and may return counts.

    An optional stage that fails is reported, and the others go on; it isn't tried again for that batch.
    """

    name: str
    work: Callable[[DataFrame, int], dict[str, int] | None]
    optional: bool = False


class Cycle:
    """Stages in order over micro-batches, with a ledger of what is done.

    Spark gives a batch that died again, with the same number and rows. Stages that the ledger has are left out then, and
    the one that died runs again; so each stage's writes must replace what the same batch wrote before
    (StoredTable.upsert, append_once), and all tables hold a batch once.
    """

    SAID = "stage string, status string, counts string"

    def __init__(self, spark: SparkSession, path: str, stages: list[Stage]):
        if len({s.name for s in stages}) < len(stages):
            raise ValueError("two stages of one name")
        self.spark, self.path, self.stages = spark, path.rstrip("/"), stages

    def _ledger(self, stage: Stage) -> str:
        return f"{self.path}/stages/stage={stage.name}"

    def __call__(self, rows: DataFrame, batch: int) -> None:
        for stage in self.stages:
            if exists(self.spark, f"{self._ledger(stage)}/batch={batch}/_SUCCESS"):
                continue
            status = "done"
            try:
                counts = stage.work(rows, batch) or {}
            except Exception as e:
                if not stage.optional:
                    raise
                counts, status = {}, f"failed: {type(e).__name__}"
            append_once(self.spark.createDataFrame([(status, json.dumps(counts, sort_keys=True))], "status string, counts string"), self._ledger(stage), batch)

    def run(self, stream: DataFrame, every: str | None = "10 minutes") -> StreamingQuery:
        return run(stream, self, f"{self.path}/checkpoint", every)

    def reports(self) -> DataFrame:
        """(batch, report): JSON of each stage's status and counts, by stage; one row a batch that has begun."""
        said = read_ledger(self.spark, f"{self.path}/stages", "stage string, status string, counts string")
        stages = F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", F.struct("status", "counts")))))  # a row a stage
        return said.groupBy("batch").agg(F.to_json(stages).alias("report"))


def notify(matches: DataFrame, table: StoredTable, batch: int) -> DataFrame:
    """Stores new matches (user_id, rule_id, event_id, ...), each once ever, and returns those of this batch."""
    keys = ["user_id", "rule_id", "event_id"]
    new = notify_once(matches, table.lookup(matches.select(*keys)))
    table.upsert(batch, new.withColumn("batch", F.lit(batch).cast("long")))
    return table.read().filter(F.col("batch") == batch)
