"""Names of a dictionary in texts, by equi-joins on what both spell: no pattern is tried on a text that doesn't share it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..saved import if_small, saved

#: A name is looked up by so many of its first words, or characters, at most.
WORDS, CHARACTERS = 3, 3
#: Names that may stand inside a word go to every task up to so many.
SENT = 200_000
Verify = Callable[[Column, Column], Column]


def _runs(text: Column, letters: str) -> Column:
    """Words: runs of `letters` (the inside of a character class)."""
    return F.filter(F.split(text, f"[^{letters}]+"), lambda w: w != "")


def _grams(parts: Column, n: Column) -> Column:
    """Runs of n parts in a row."""
    return F.when(F.size(parts) >= n, F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))).otherwise(F.array().cast("array<string>"))


def named_in(texts: DataFrame, names: DataFrame, letters: str, verify: Verify) -> DataFrame:
    """(id, name_id) once for each name that occurs in a text as whole words.

    texts: (id, text) and names: (name_id, name), both lower-cased; verify(text, name) says whether a name occurs and
    implies that its words, runs of `letters`, stand in a row in the text as whole words. A name of one word is found
    by that word alone, any other by its first words, as many as three, and then verified. Names without letters go
    by their first character. The names' keys are sent to every task up to a checked number, and joined by shuffle
    beyond; texts of what was found are fetched by their id.
    """
    words = _runs(F.col("name"), letters)
    key = names.filter("trim(name) <> ''").select("name_id", "name", words.alias("_w")).withColumn("n", F.least(F.size("_w"), F.lit(WORDS)))
    sure = F.col("name").rlike(f"^[{letters}]+$")
    key = key.select("name_id", "n", F.when(F.col("n") > 0, F.array_join(F.slice("_w", F.lit(1), F.col("n")), " ")).otherwise(F.substring(F.ltrim("name"), 1, 1)).alias("gram"), sure.alias("sure"))
    key = saved(key.withColumn("key", F.xxhash64("n", "gram")))
    lengths = sorted(r[0] for r in key.select("n").distinct().collect())  # 0 to WORDS
    if not lengths:
        return texts.select("id").crossJoin(names.select("name_id")).limit(0)
    spelled = texts.select("id", _runs(F.col("text"), letters).alias("_w"), "text" if 0 in lengths else F.lit(None).alias("text"))

    def grams(n: int) -> Column:
        if n == 0:
            return F.array_distinct(F.split(F.regexp_replace("text", rf"[\s{letters}]+", ""), ""))
        return F.array_distinct(F.col("_w") if n == 1 else _grams(F.col("_w"), F.lit(n)))

    def numbered(n: int) -> Column:
        return F.transform(grams(n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    each = F.concat(*[numbered(n) for n in lengths])
    said = spelled.select("id", F.explode(each).alias("g")).select("id", F.xxhash64("g.n", "g.gram").alias("key"), "g.n", "g.gram")
    # hashes meet, and what they stand for is compared
    hits = said.join(if_small(key.withColumnRenamed("n", "_n").withColumnRenamed("gram", "_gram"), 1_000_000), "key").filter("n = _n and gram = _gram").select("id", "name_id", "sure")
    hits = saved(hits)
    return hits.filter("sure").select("id", "name_id").distinct().unionByName(_verified(hits.filter("not sure"), texts, names, verify))


def contained_in(texts: DataFrame, names: DataFrame, verify: Verify = lambda text, name: text.contains(name)) -> DataFrame:
    """(id, name_id) once for each name that a text contains, wherever, and that verify allows; names meet texts by their first characters, as many as three."""
    key = saved(names.filter("name <> ''").select("name_id", "name", F.least(F.length("name"), F.lit(CHARACTERS)).alias("n"), F.substring("name", 1, CHARACTERS).alias("gram")))
    lengths = sorted(r[0] for r in key.select("n").distinct().collect())  # 1 to CHARACTERS
    if not lengths:
        return texts.select("id").crossJoin(names.select("name_id")).limit(0)

    def grams(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length("text") - n + 1)
        return F.when(F.length("text") >= n, F.array_distinct(F.transform(at, lambda i: F.substring(F.col("text"), i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    each = F.explode(F.concat(*[grams(n) for n in lengths])).alias("gram")
    if key.limit(SENT + 1).count() <= SENT:
        # names are tried where the text lies: of names that begin alike, only those that occur leave the task
        met = texts.select("id", "text", each).join(F.broadcast(key.select("name_id", "name", "gram")), "gram")
        return met.filter(verify(F.col("text"), F.col("name"))).select("id", "name_id").distinct()
    hits = saved(texts.select("id", each).join(if_small(key.select("name_id", "gram"), 1_000_000), "gram").select("id", "name_id"))
    return _verified(hits, texts, names, verify)


def _verified(hits: DataFrame, texts: DataFrame, names: DataFrame, verify: Verify) -> DataFrame:
    """Those of hits (id, name_id; saved) whose name occurs in the text."""
    pairs = hits.select("id", "name_id").distinct()
    # names are shorter than texts, so they come to the pairs first
    named = pairs.join(names.select("name_id", "name"), "name_id")
    return texts.select("id", "text").join(named, "id").filter(verify(F.col("text"), F.col("name"))).select("id", "name_id")
