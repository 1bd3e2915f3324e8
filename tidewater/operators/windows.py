"""Latest rows, changes, admission and top-n by window (W1-W12) and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import hours_between


def latest(df: DataFrame, keys: list[str], at: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key, all columns; a newest value that is null stays null. Combined before the shuffle."""
    order = F.struct(at, *([tie] if tie else []))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def score_changes(scores: DataFrame, keys: tuple[str, ...] = ("event_id", "kind"), at: str = "computed_at", tie: str = "id", value: str = "value") -> DataFrame:
    """Rows whose value differs from the one before (null-safe), with the old and new value and a reason."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    seen = scores.withColumns({"old_value": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    reason = F.when(F.col("_first"), "initial").when(F.col("old_value").isNull(), "became_known").when(F.col(value).isNull(), "became_unknown").otherwise("changed")
    return seen.filter(F.col("_first") | ~F.col(value).eqNullSafe(F.col("old_value"))).withColumn("reason", reason).withColumnRenamed(value, "new_value").drop("_first")


def transitions(states: DataFrame, key: str = "event_id", at: str = "at", tie: str = "id", state: str = "state") -> DataFrame:
    w = Window.partitionBy(key).orderBy(at, tie)
    return states.withColumn("from_state", F.lag(state).over(w)).filter(~F.col(state).eqNullSafe(F.col("from_state"))).withColumnRenamed(state, "to_state")


def cooldown(views: DataFrame, keys: list[str], minutes: float, at: str = "at", tie: str = "id") -> Column:
    """Whether the row before of the same keys lies within the time; rejected rows count, so refreshes extend it."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at, tie))
    return F.coalesce(hours_between(F.col(at), before) * 60 < minutes, F.lit(False))


def prior_count(key: str, hours: float, at: str = "at") -> Column:
    """Rows of the key in the time before this row's, this row's own time left out."""
    micros = int(hours * 3_600_000_000)
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-micros + 1, -1)
    return F.count(F.lit(1)).over(w)


def hourly_rate(key: str, limit: int, hours: float = 1, at: str = "at") -> Column:
    return prior_count(key, hours, at) >= limit


def growth(views: DataFrame, as_of: Column, key: str = "event_id", at: str = "at") -> DataFrame:
    age = hours_between(as_of, F.col(at))
    counted = F.coalesce(F.col("counted"), F.lit(False))
    return views.groupBy(key).agg(
        F.count_if(counted & (age >= 0) & (age < 24)).alias("views_24h"), F.count_if(counted & (age >= 24) & (age < 48)).alias("views_prev_24h")
    )


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; Spark cuts each partition to n rows a key before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def newest_overall(df: DataFrame, n: int, at: str, tie: str) -> DataFrame:
    """df with `keep`: whether a row is among the n newest; the bound is found by a top-n, not by one sorted window."""
    bound = df.filter(F.col(at).isNotNull()).orderBy(F.desc(at), F.desc(tie)).limit(n).agg(F.min(F.struct(at, tie)).alias("_b"), F.count("*").alias("_n"))
    inside = F.coalesce(F.struct(F.col(at), F.col(tie)) >= F.col("_b"), F.lit(False)) & F.col(at).isNotNull()
    return df.crossJoin(F.broadcast(bound)).withColumn("keep", inside).drop("_b", "_n")  # the bound is one row


def protect_latest(df: DataFrame, keys: list[str], at: str, id_col: str, old: Column) -> DataFrame:
    """Rows to delete: old ones that aren't the newest of their keys."""
    newest = df.groupBy(*keys).agg(F.max_by(id_col, F.struct(at, id_col)).alias(id_col)).select(id_col)
    return df.filter(old).join(newest, id_col, "left_anti")


def winner(hits: DataFrame, key: str, label: str, score: str, ordinal: str) -> DataFrame:
    """Best label of each key with the runner-up's score (0 without one); ties go to the smaller ordinal."""
    w = Window.partitionBy(key).orderBy(F.desc(score), ordinal)
    seen = hits.withColumns({"_r": F.row_number().over(w), "runner_up": F.coalesce(F.lead(score).over(w), F.lit(0))})
    return seen.filter("_r = 1").select(key, label, score, "runner_up")


ORDERS = {
    "recent": ["last_activity_at"],
    "relevance": ["relevance", "last_activity_at"],
    "confidence": ["confidence", "last_activity_at"],
    "impact": ["life_impact", "last_activity_at"],
    "life_impact": ["life_impact", "last_activity_at"],
    "trending": ["trending", "last_activity_at"],
    "views": ["views_total", "last_activity_at"],
}


def order_columns(order: str = "recent", direction: str = "desc") -> list[Column]:
    """Sort columns with nulls last both ways, then recency, then the id; an unknown order is recency."""
    first, *rest = ORDERS.get(order, ORDERS["recent"])
    lead = F.asc_nulls_last(first) if direction == "asc" else F.desc_nulls_last(first)
    return [lead, *[F.desc_nulls_last(c) for c in rest], F.asc("event_id")]


def order_events(df: DataFrame, order: str = "recent", direction: str = "desc") -> DataFrame:
    return df.orderBy(*order_columns(order, direction))


def page(df: DataFrame, limit: int | None = 30, offset: int = 0) -> DataFrame:
    return df.offset(max(0, offset or 0)).limit(min(100, max(1, 30 if limit is None else limit)))


def review_order(queue: DataFrame, n: int = 100) -> DataFrame:
    return queue.orderBy(F.desc("priority"), F.asc("created_at"), "event_id").limit(n)


def recent(log: DataFrame, n: int, at: str = "at", tie: str = "id") -> DataFrame:
    return log.orderBy(F.desc(at), F.desc(tie)).limit(min(500, n))


def top_by_articles(events: DataFrame, n: int = 12) -> DataFrame:
    return events.orderBy(F.desc("article_count"), "event_id").limit(n)
