"""Location quality: registry overrides, confidence, review."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trust
from ..functions.geo import haversine_km
from ..functions.text import normalize_call
from ..sources.scratch import scratch


#: What an entry of the registry may say about itself, kept with what it does to a station.
AUDIT = ("status", "reason", "source", "source_url")


def assess(stations: DataFrame, registry: DataFrame, matches: DataFrame | None, as_of: int) -> DataFrame:
    """Stations with source, score, label, reasons, freshness, map status and match, the position first reported, and the registry's correction or review candidate.

    An entry without a status is a candidate, and its case does not matter. last_seen stands in for lasttime where there is such a
    column. Only a reviewed entry with coordinates moves a station; any other entry is a candidate for review. correction and review hold the entry
    (status, reason, source, source_url, candidate_lat, candidate_lon). Rows without coordinates pass through unscored. Stations assessed before keep the position
    that they reported then. matches: callsign, matched, distance_m, and what else nearest_feature() finds, which goes to the struct osm.
    """
    told = lambda c: F.coalesce(F.col(c), F.lit("")) if c in registry.columns else F.lit("")
    status = F.lower(F.coalesce(F.nullif("status", F.lit("")), F.lit("candidate")))
    audit = F.struct(status.alias("status"), *[told(c).alias(c) for c in AUDIT[1:]], F.col("lat").alias("candidate_lat"), F.col("lon").alias("candidate_lon"))
    entries = registry.select(normalize_call(F.col("callsign")).alias("k"), status.alias("reg_status"), audit.alias("__audit"))
    again = [c for c in ("matched", "distance_m", "reg_status", "osm", "reported_source", "osm_status", "score", "label", "reasons", "freshness", "age_days", "freshness_reason", "corrected", "review_candidate", "correction", "review", "location_source") if c in stations.columns]
    rows = stations.drop(*again).withColumn("__k", normalize_call(F.col("callsign"))).join(F.broadcast(entries) if _is_small(registry) else entries, F.col("__k") == F.col("k"), "left").drop("__k", "k")
    if matches is None:
        rows = rows.withColumns({"checked": F.lit(False), "matched": F.lit(None).cast("boolean"), "distance_m": F.lit(None).cast("long"), "osm": F.lit(None).cast("struct<matched: boolean>")})
    else:
        about = F.struct(*[c for c in matches.columns if c != "callsign"])
        rows = rows.join(matches.select(F.col("callsign").alias("m"), F.lit(True).alias("checked"), "matched", "distance_m", about.alias("osm")), F.col("callsign") == F.col("m"), "left").drop("m").withColumn("checked", F.coalesce("checked", F.lit(False)))
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    entry = F.col("__audit")
    moved = located & (F.col("reg_status") == "reviewed") & entry["candidate_lat"].isNotNull() & entry["candidate_lon"].isNotNull()
    moved = F.coalesce(moved, F.lit(False))
    waiting = F.coalesce(located & F.col("reg_status").isNotNull() & ~moved, F.lit(False))
    name = trust.source_name(F.trim("source"), F.col("seed_only"))
    status = trust.osm_status(F.col("checked"), F.col("matched"), F.col("distance_m"))
    score = F.when(located, trust.confidence_score(name, F.col("seed_only"), status, F.col("reg_status")))
    age = trust.age_days(F.col("lasttime"), F.col("last_seen") if "last_seen" in stations.columns else None, as_of)
    first = lambda c: F.coalesce(F.col(f"reported_{c}"), F.col(c)) if f"reported_{c}" in stations.columns else F.col(c)
    rows = rows.withColumns(
        {
            "reported_source": name, "osm_status": F.when(located, status), "score": score, "label": F.when(located, trust.confidence_label(score)),
            "reasons": F.when(located, trust.confidence_reasons(name, F.col("seed_only"), status, F.col("reg_status"))),
            "freshness": trust.freshness_label(age), "age_days": age, "freshness_reason": trust.freshness_reason(age), "corrected": moved, "review_candidate": waiting,
            "correction": F.when(moved, entry), "review": F.when(waiting, entry), "location_source": F.when(moved, "reviewed_override"),
            "reported_lat": F.when(located, first("lat")), "reported_lon": F.when(located, first("lon")),
        }
    )
    return rows.withColumns({"lat": F.when(moved, F.col("correction.candidate_lat")).otherwise(F.col("lat")), "lon": F.when(moved, F.col("correction.candidate_lon")).otherwise(F.col("lon"))}).drop("__audit", "checked")


def _is_small(registry: DataFrame, rows: int = 200_000) -> bool:
    """Whether the registry has few enough rows to be broadcast."""
    return registry.limit(rows + 1).count() <= rows


def quality_summary(assessed: DataFrame) -> DataFrame:
    return assessed.agg(
        F.count_if(F.col("label") == "HIGH").alias("high"), F.count_if(F.col("label") == "MEDIUM").alias("medium"), F.count_if(F.col("label") == "LOW").alias("low"), F.count_if("corrected").alias("corrected"),
        F.count_if("review_candidate").alias("review"), F.count_if(F.col("osm_status") == "AUTO_CORROBORATED").alias("osm_auto"),
    )


def needs_review(assessed: DataFrame) -> DataFrame:
    return assessed.filter((F.col("label") == "LOW") | F.col("review_candidate"))


def review_queue(assessed: DataFrame) -> DataFrame:
    """Rows to review with their successor in (score, call) order, missing scores last.

    The queue is range-partitioned and written; a row's successor is the next of its partition, and the last row's the first of the next partition that has any.
    """
    spark = assessed.sparkSession
    rows = needs_review(assessed).withColumn("queue_score", F.coalesce("score", F.lit(999)))
    path = scratch(spark, "queue")
    rows.repartitionByRange("queue_score", "callsign").withColumn("__part", F.spark_partition_id()).write.parquet(path)
    queue = spark.read.parquet(path)
    heads = sorted((r["__part"], r["head"]) for r in queue.groupBy("__part").agg(F.min(F.struct("queue_score", "callsign"))["callsign"].alias("head")).collect())  # one row for each partition
    after = spark.createDataFrame([(a, b) for (a, _), (_, b) in zip(heads, heads[1:], strict=False)], "__p int, __after string")
    inside = F.lead("callsign").over(Window.partitionBy("__part").orderBy("queue_score", "callsign"))
    found = queue.withColumn("__next", inside).join(F.broadcast(after), F.col("__part") == F.col("__p"), "left")
    return found.withColumn("next_call", F.coalesce("__next", "__after")).select(*assessed.columns, "queue_score", "next_call")


def filter_region(stations: DataFrame, lat: float, lon: float, radius_km: float, types=("digi", "igate")) -> DataFrame:
    """Stations of the given types within radius_km; a box around the circle comes first, so that it reaches the scan.

    The box has no bounds of longitude where the circle takes in a pole, and two parts where it crosses 180 degrees.
    """
    band = radius_km / 111.0
    near = F.col("type").isin(*types) & F.col("lat").between(lat - band, lat + band) & F.col("lon").isNotNull()
    if abs(lat) + band < 90:
        angle = radius_km / 6371.0088
        wide = math.degrees(math.asin(min(1.0, math.sin(min(angle, math.pi / 2)) / math.cos(math.radians(lat))))) * 1.01
        west, east = lon - wide, lon + wide
        box = F.col("lon").between(west, east)
        if west < -180:
            box = box | (F.col("lon") >= west + 360)
        if east > 180:
            box = box | (F.col("lon") <= east - 360)
        near = near & box
    return stations.filter(near).filter(haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= radius_km)


def filter_box(stations: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    return stations.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def override_coordinates(stations: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace coordinates by call (overrides: callsign, lat, lon)."""
    new = overrides.select(F.col("callsign").alias("__k"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    return stations.join(new, F.col("callsign") == F.col("__k"), "left").withColumns({"lat": F.coalesce("__lat", "lat"), "lon": F.coalesce("__lon", "lon")}).drop("__k", "__lat", "__lon")
