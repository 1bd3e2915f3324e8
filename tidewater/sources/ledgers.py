"""Ledgers, folded change logs, conflict rows and subject exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import conflict_id


def append_ledger(rows: DataFrame, path: str, at: str = "at", batch: int | None = None) -> None:
    """Appends rows to a ledger that is partitioned by day; with a batch number, a batch that is written again stands once."""
    days = rows.withColumn("day", F.to_date(at))
    if batch is None:
        days.write.mode("append").partitionBy("day").parquet(path)
    else:
        days.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def upsert_conflicts(old: DataFrame, found: DataFrame) -> DataFrame:
    """Conflicts by deterministic id: what is found again is replaced and open."""
    new = found.select(conflict_id(F.col("event_id").cast("string"), F.col("field")).alias("conflict_id"), "event_id", "field", F.to_json("values").alias("detail"), F.lit(False).alias("resolved"))
    return old.join(new.select("conflict_id"), "conflict_id", "left_anti").select(new.columns).unionByName(new)


def fold_changes(log: DataFrame, keys: list[str], at: str = "at", tie: str = "id", action: str = "action") -> DataFrame:
    """What stands after a log of actions: the last of add and remove (or delete, disable); toggles by their parity.

    Keys whose last action takes away are gone. A log mixes toggles with other actions of a key at most by order:
    toggles count since the last other action.
    """
    order = F.struct(at, tie)
    toggle = F.col(action) == "toggle"
    last = log.groupBy(*keys).agg(F.max_by(F.when(~toggle, F.col(action)), F.when(~toggle, order)).alias("_a"), F.max(F.when(~toggle, order)).alias("_o"), F.max(order).alias("_last"))
    flips = log.filter(toggle).join(last.select(*keys, "_o"), keys).filter(F.col("_o").isNull() | (order > F.col("_o"))).groupBy(*keys).agg(F.count("*").alias("_n"))
    start = F.coalesce(~F.col("_a").isin("remove", "delete", "disable"), F.lit(False))
    on = F.coalesce("_n", F.lit(0)) % 2 == 1
    return last.join(flips, keys, "left").filter(start != on).select(*keys, F.col(f"_last.{at}").alias("since"))


def subject_export(user_ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(user_id, one JSON array column a table): all rows that users own."""
    out = user_ids.select("user_id").distinct()
    for name, rows in tables.items():
        mine = rows.join(out.select("user_id"), "user_id", "left_semi")
        rest = [c for c in rows.columns if c != "user_id"]
        packed = mine.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias(name))
        out = out.join(packed, "user_id", "left").withColumn(name, F.coalesce(name, F.lit("[]")))
    return out


def subject_erasure(user_ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without the users' rows."""
    ids = user_ids.select("user_id").filter("user_id is not null").distinct()
    return {name: rows.join(ids, "user_id", "left_anti") for name, rows in tables.items()}


def rate_limited(requests: DataFrame, limit: int, seconds: int, key: list[str], at: str = "at", tie: str = "id") -> DataFrame:
    """Batch form of the fixed-window limit: windows opened by a key's first request; rows over the limit.

    Windows depend on where the one before began, so a key's rows are walked in order, streamed through a partition.
    """
    from ..streaming.limits import walk_windows

    return walk_windows(requests, limit, seconds, key, at, tie)
