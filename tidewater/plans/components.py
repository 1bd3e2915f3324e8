"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..saved import if_small, saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for each node that has a link.

    Alternates large-star and small-star steps (Kiveris et al. 2014); each round is saved to the shared folder
    and the loop ends when a round changes nothing. Null ends and self-links take no part. A node with very
    many links is never gathered: every step is a minimum per node (combined before the shuffle, and saved) and a
    join of saved tables, which Spark splits where it is skewed.
    """
    e = (
        edges.filter("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    e = saved(e)
    before = None
    for _ in range(rounds):
        # large star: every neighbour above u points to the smallest of u's neighbours and u
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = if_small(saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.filter("u <> v").distinct())
        # small star: u and its smaller neighbours point to the smallest of them
        low = if_small(saved(large.groupBy("u").agg(F.min("v").alias("m"))))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .filter("u <> v")
            .distinct()
        )
        e = saved(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
