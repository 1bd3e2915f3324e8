"""Numbers: distances, rounded scores, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# Hours under which an event is FRESH, RECENT, AGING, STALE; beyond the last it is EXPIRED.
FRESHNESS_HOURS = {
    "natural_events": (1, 6, 24, 72),
    "war_conflict": (2, 8, 24, 96),
    "finance": (1, 4, 12, 48),
    "crypto": (1, 4, 12, 48),
    "economy": (6, 24, 72, 240),
    "politics": (6, 24, 96, 336),
    "health": (6, 24, 96, 336),
    "transport": (3, 12, 48, 168),
    "energy": (6, 24, 96, 336),
    "technology": (12, 48, 168, 720),
    "ai": (12, 48, 168, 720),
    "science": (24, 96, 336, 1440),
    "space": (24, 96, 336, 1440),
    "default": (6, 24, 96, 336),
}


def rounded(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5).cast("int")


def clamp_score(x: Column) -> Column:
    """Half up, then 0 to 100; null stays null."""
    r = rounded(x)
    return F.when(r.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), r)))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3_600_000_000.0)


def age_hours(at: Column, as_of: Column) -> Column:
    """Hours since `at`; a time in the future has age 0."""
    return F.greatest(hours_between(as_of, at), F.lit(0.0))


def freshness_thresholds(category: Column) -> Column:
    known = F.create_map(*[x for k, v in FRESHNESS_HOURS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(known, category), F.array(*map(F.lit, FRESHNESS_HOURS["default"])))


def freshness(category: Column, at: Column, as_of: Column) -> Column:
    age, limits = age_hours(at, as_of), freshness_thresholds(category)
    out = F.lit("EXPIRED")
    for i, name in reversed(list(enumerate(("FRESH", "RECENT", "AGING", "STALE")))):
        out = F.when(age < limits[i], name).otherwise(out)
    return F.when(at.isNotNull(), out)


def relative_age(at: Column, as_of: Column) -> Column:
    s = F.floor(age_hours(at, as_of) * 3600)
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(name))
    return F.when(s < 60, "seconds").when(s < 3600, unit(60, " min")).when(s < 86400, unit(3600, " h")).otherwise(unit(86400, " d"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def sphere_cell(lat: Column, lon: Column, km: float) -> Column:
    """The cube (x, y, z numbers) of side `km` around the earth's centre that a place lies in."""
    x = F.cos(F.radians(lat)) * F.cos(F.radians(lon))
    y = F.cos(F.radians(lat)) * F.sin(F.radians(lon))
    z = F.sin(F.radians(lat))
    return F.struct(*[F.floor(c * (EARTH_KM / km)).cast("int").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])


def saturating(n: Column, scale: float = 30, most: int = 60) -> Column:
    return F.least(F.lit(most), rounded(F.log10(n + F.lit(1)) * scale))


def clamp_future(at: Column, as_of: Column) -> Column:
    return F.least(at, as_of)
