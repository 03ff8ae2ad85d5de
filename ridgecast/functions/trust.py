"""How far a station's coordinates can be trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base score by source, fixed values.
BASE_SCORE = {"APRS-IS": 90, "aprs.fi": 85, "reviewed_override": 100, "seed": 65, "cache": 70, "unknown": 55}
#: Sources whose position a mapped site may contradict.
WEAK_SOURCES = ("seed", "cache", "unknown")
#: OpenStreetMap tags (key, value; None: any value) that mark a communications site, fixed values.
SITE_TAGS = [
    ("tower:type", "communication"),
    ("man_made", "communications_tower"),
    ("man_made", "antenna"),
    ("communication:radio", None),
    ("communication:microwave", None),
    ("communication:mobile_phone", None),
]
#: Tags shown for a matched site, fixed values.
SUMMARY_TAGS = ["communication:radio", "communication:microwave", "communication:mobile_phone", "communication:television", "operator", "height"]


def source_name(source: Column, seed_only: Column) -> Column:
    return F.when(source.isin(*BASE_SCORE), source).when(F.coalesce(seed_only, F.lit(False)), "seed").otherwise("unknown")


def source_base_score(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BASE_SCORE.items() for x in pair])
    return F.coalesce(table[source], F.lit(BASE_SCORE["unknown"]))


def age_days(lasttime: Column, last_seen: Column | None, as_of: int) -> Column:
    """Days since the last sighting; null when unknown."""
    seen = F.nullif(lasttime, F.lit(0)) if last_seen is None else F.coalesce(F.nullif(lasttime, F.lit(0)), F.nullif(last_seen, F.lit(0)))
    return F.when(seen > 0, F.greatest(F.lit(0.0), (F.lit(as_of) - seen) / 86400.0))


def freshness_label(age: Column) -> Column:
    return F.when(age.isNull(), "UNKNOWN").when(age <= 7, "RECENT").when(age <= 90, "AGING").when(age <= 365, "STALE").otherwise("VERY_STALE")


def freshness_reason(age: Column) -> Column:
    return F.when(age.isNull(), "no usable last-heard time").otherwise(F.concat(F.lit("last heard "), F.floor(age).cast("string"), F.lit(" days before the reference date")))


def osm_status(checked: Column, matched: Column, distance_m: Column) -> Column:
    """NOT_CHECKED, NO_MATCH, INVALID_MATCH, AUTO_CORROBORATED, PROBABLE or DISAGREES."""
    return (
        F.when(~checked, "NOT_CHECKED").when(~F.coalesce(matched, F.lit(False)), "NO_MATCH").when(distance_m.isNull() | (distance_m < 0), "INVALID_MATCH")
        .when(distance_m <= 150, "AUTO_CORROBORATED").when(distance_m <= 500, "PROBABLE").otherwise("DISAGREES")
    )


def osm_adjusted(score: Column, status: Column, source: Column) -> Column:
    """The score after the map's word."""
    at_least = F.when(status == "AUTO_CORROBORATED", 85).when(status == "PROBABLE", 70).otherwise(0)
    at_most = F.when((status == "DISAGREES") & source.isin(*WEAK_SOURCES), 49).otherwise(100)
    return F.least(F.greatest(score, at_least), at_most)


def confidence_score(source: Column, seed_only: Column, status: Column, registry_status: Column) -> Column:
    """0 to 100."""
    score = F.least(source_base_score(source), F.when(F.coalesce(seed_only, F.lit(False)), 65).otherwise(100))
    score = F.least(osm_adjusted(score, status, source), F.when(registry_status.isNotNull(), 49).otherwise(100))
    return F.when(registry_status == "reviewed", 100).otherwise(F.greatest(F.lit(0), score)).cast("int")


def confidence_reasons(source: Column, seed_only: Column, status: Column, registry_status: Column) -> Column:
    """What went into the score, in order."""
    return F.array_compact(
        F.array(
            F.concat(F.lit("source "), source),
            F.when(F.coalesce(seed_only, F.lit(False)), "seed position not confirmed"),
            F.when(status != "NOT_CHECKED", F.concat(F.lit("map "), status)),
            F.when(registry_status == "reviewed", "reviewed override").when(registry_status.isNotNull(), F.concat(F.lit("registry "), registry_status)),
        )
    )


def confidence_label(score: Column) -> Column:
    return F.when(score >= 80, "HIGH").when(score >= 55, "MEDIUM").otherwise("LOW")


def osm_label(tags: Column, default: str = "mapped radio site") -> Column:
    """The best name that a mapped feature's tags give."""
    tag = lambda k: F.nullif(F.trim(tags[k]), F.lit(""))
    return F.coalesce(tag("name"), tag("ref"), tag("operator"), F.replace(tag("man_made"), F.lit("_"), F.lit(" ")), F.concat(tag("tower:type"), F.lit(" tower")), F.lit(default))


def osm_strength(distance_km: Column) -> Column:
    return F.when(distance_km <= 0.10, "STRONG").when(distance_km <= 0.30, "GOOD").when(distance_km <= 1.0, "NEARBY").otherwise("WEAK")


def is_site(tags: Column) -> Column:
    """Any of the communications tags."""
    hits = [F.coalesce(tags[k] == v, F.lit(False)) if v else tags[k].isNotNull() for k, v in SITE_TAGS]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def tag_summary(tags: Column, most: int = 4) -> Column:
    """The first present tags of the list, as k=v."""
    pairs = F.array_compact(F.array(*[F.when(F.nullif(tags[k], F.lit("")).isNotNull(), F.concat(F.lit(f"{k}="), tags[k])) for k in SUMMARY_TAGS]))
    return F.array_join(F.slice(pairs, 1, most), ", ")
