"""Feeds that land as files and are streamed in, and queries in which every field of a reader or score is told."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables as T
from ..operators import aggregates as A
from ..plans import enrich, scoring
from ..saved import shared_dir
from ..streaming import cycle
from . import query
from .events import INPUTS, inputs
from .more import _measured

#: Items a feed file has at most.
ITEMS_A_FILE = 2000


def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def _feed_item(k: Column) -> Column:
    """An item of a hazard feed about page k; elements, attributes and stated numbers are left out where k says so."""
    s = lambda c: c.cast("string")
    day = F.date_format(F.timestamp_micros(F.lit(1704164645000000) + (k % 28) * 86_400_000_000), "EEE, dd MMM yyyy HH:mm:ss")
    told = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit("Magnitude "), s(k % 9), F.lit(".5M "))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("Depth: "), s(k % 70), F.lit("km"))).otherwise("")
    )
    return F.concat(
        F.lit("<item>"), _element("title", F.concat(F.lit("Page "), s(k))), _element("link", F.concat(F.lit("https://n.example/"), s(k))), _element("pubDate", F.concat(day, F.lit(" GMT"))),
        F.when(k % 11 != 0, _element("georss:point", F.concat(s(k % 90), F.lit(" "), s(k % 170)))).otherwise(""),
        F.when(k % 13 != 0, _element("gdacs:country", F.concat(F.lit("Land "), s(k % 7), F.lit(", Sea")))).otherwise(""),
        F.when(k % 5 != 0, F.concat(F.lit('<gdacs:severity unit="km/h" value="'), s(k % 200), F.lit('">strong</gdacs:severity>'))).otherwise(""),
        F.when(k % 7 != 0, F.concat(F.lit('<gdacs:population value="'), s(k % 1000), F.lit('" unit="people"/>'))).otherwise(""),
        F.when(k % 17 != 0, _element("gdacs:alertlevel", F.when(k % 2 == 0, "Green").otherwise("Orange"))).otherwise(""),
        _element("gdacs:eventtype", F.when(k % 3 == 0, "EQ").otherwise("TC")), _element("gdacs:eventid", s(k % 500)), _element("description", told), F.lit("</item>"),
    )


_STATED = {
    "severity_value": "CASE WHEN k % 5 <> 0 THEN (k % 200)::VARCHAR END", "severity_unit": "CASE WHEN k % 5 <> 0 THEN 'km/h' END",
    "population_affected": "CASE WHEN k % 7 <> 0 THEN (k % 1000)::VARCHAR END", "population_unit": "CASE WHEN k % 7 <> 0 THEN 'people' END",
    "alert_level": "CASE WHEN k % 17 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'Green' ELSE 'Orange' END END", "event_type": "CASE WHEN k % 3 = 0 THEN 'EQ' ELSE 'TC' END",
    "provider_event_id": "(k % 500)::VARCHAR", "depth_km": "CASE WHEN k % 3 = 0 THEN (k % 70)::VARCHAR END", "magnitude": "CASE WHEN k % 2 = 0 THEN (k % 9) || '.5' END",
}


@query(
    "landed_items",
    f"""SELECT 'https://n.example/' || k AS link, 'Page ' || k AS title, 'ART-' || substr(sha1('https://n.example/' || k), 1, 16) AS article_id, epoch_us(TIMESTAMP '2024-01-02 03:04:05' + INTERVAL 1 DAY * (k % 28)) AS published_us,
    CASE WHEN k % 11 <> 0 THEN (k % 90)::DOUBLE END AS lat, CASE WHEN k % 11 <> 0 THEN (k % 170)::DOUBLE END AS lon, CASE WHEN k % 13 <> 0 THEN 'Land ' || k % 7 END AS country_name,
    {", ".join(f"{v} AS {c}" for c, v in _STATED.items())} FROM (SELECT page_id AS k FROM pages)""",
)
def landed_items(spark, d):
    """A feed item of each page, a third of them in two files, written to a landing folder and streamed in once each."""
    k = F.col("page_id")
    pages = T.feed_bodies(spark, d).select("page_id")
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    feed = pages.unionByName(pages.filter(k % 3 == 0)).select(_feed_item(k).alias("value"))
    feed.write.option("maxRecordsPerFile", ITEMS_A_FILE).text(f"{at}/landing")
    # the pages' days span 28, in no order by file
    items = cycle.landed_items(spark, f"{at}/landing", f"{at}/items", T.at("2024-06-01 00:00:00"), delay="40 days")
    stated = [F.try_element_at("measurements", F.lit(c)).alias(c) for c in _STATED]
    return items.select("link", "title", "article_id", F.unix_micros("published_at").alias("published_us"), "lat", "lon", "country_name", *stated)


_TOLD = "'magnitude ' || l_linenumber || ', depth of ' || (1200 + l_suppkey % 2) || ' km: ' || (l_partkey % 4) || ' people killed and 1,' || (100 + l_suppkey % 3) || ' wounded'"
_FIELDS = {"magnitude": "magnitude ([0-9]+)", "depth_km": "depth of ([0-9]+) km", "fatalities": "([0-9]+) people killed", "injured": "and ([0-9,]+) wounded"}


@query(
    "conflict_fields",
    f"""WITH a AS (SELECT l_orderkey AS event_id, {_TOLD} AS t FROM lineitem), n AS (SELECT event_id FROM a GROUP BY 1 HAVING count(*) >= 2),
    c AS ({" UNION ALL ".join(f"SELECT event_id, '{f}' AS field, replace(regexp_extract(t, '{p}', 1), ',', '') AS v FROM a" for f, p in _FIELDS.items())})
    SELECT event_id, field, array_to_string(list_sort(list(DISTINCT v)), ',') AS vals FROM c SEMI JOIN n USING (event_id) GROUP BY event_id, field HAVING count(DISTINCT v) > 1""",
)
def conflict_fields(spark, d):
    """Contradictions in all four fields, with thousands commas and people between a number and its word."""
    line, source, part = (F.col(c) for c in ("line", "source_id", "part"))
    said = F.concat(
        F.lit("magnitude "), line.cast("string"), F.lit(", depth of "), (1200 + source % 2).cast("string"), F.lit(" km: "), (part % 4).cast("string"), F.lit(" people killed and 1,"), (100 + source % 3).cast("string"), F.lit(" wounded"),
    )
    rows = enrich.detect_conflicts(T.articles(spark, d).select("event_id", said.alias("title"), F.lit(None).cast("string").alias("summary")))
    return rows.select("event_id", "field", F.array_join("values", ",").alias("vals"))


_EVIDENCE = "(CASE WHEN official_sources > 0 THEN 35 ELSE 0 END) + least(independent_sources, 4) * 10 + (CASE WHEN measured THEN 15 ELSE 0 END) - (CASE WHEN conflicts > 0 THEN 20 ELSE 0 END)"


@query(
    "measured_scores",
    f"""WITH {INPUTS}, ms AS (SELECT l_orderkey AS event_id, arg_min(l_partkey % 9, (l_shipdate, l_linenumber, l_suppkey, l_partkey)) FILTER (l_partkey % 5 = 0) AS m, bool_or(l_partkey % 2 = 0 OR l_partkey % 5 = 0) AS measured FROM lineitem GROUP BY 1)
    SELECT event_id, CASE WHEN base IS NOT NULL THEN CAST(least(100, base + coalesce(floor(greatest(0.0, (m - 4) * 12.0) + 0.5), 0) + least(countries, 4) * 5 + least(independent_sources, 4) * 3) AS BIGINT) END AS life_impact,
      CASE WHEN {_EVIDENCE} > 0 THEN CAST(least(100, {_EVIDENCE}) AS BIGINT) END AS evidence_strength FROM sv LEFT JOIN ms USING (event_id)""",
)
def measured_scores(spark, d):
    """Impact by the magnitude that an event's first article states, evidence by whether any measures anything."""
    first = A.first_measurements(_measured(spark, d)).groupBy("event_id").agg(
        F.max(F.when(F.col("measure") == "magnitude", F.col("value").cast("double"))).alias("magnitude"), F.lit(True).alias("measured")
    )
    e = inputs(spark, d).join(first, "event_id", "left")
    rows = scoring.score_events(e, T.at(T.AS_OF), magnitude=F.col("magnitude"), measured=F.coalesce("measured", F.lit(False)))
    return A.pivot_scores(rows, ["life_impact", "evidence_strength"])
