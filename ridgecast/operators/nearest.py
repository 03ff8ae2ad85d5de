"""Nearest mapped feature within a radius, by buckets and an equi-join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, valid_coordinate
from ..functions.trust import osm_strength


EARTH_KM = 6371.0088


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """A place as x, y, z on the unit sphere, which has neither seam nor poles."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def nearest_feature(stations: DataFrame, features: DataFrame, radius_km: float, order: str = "osm_id", station_order: str = "ord") -> DataFrame:
    """callsign, matched, osm_type, osm_id, label, distance_km, distance_m, strength, radius_km: the nearest feature within the radius (0.1 to 10 km).

    Places are points of the unit sphere, in cubes as wide as the chord of the radius: a station looks into its cube and the 26 around, and no pair further
    apart than these is formed. Of several rows of a call the first with a place on the globe counts, in station_order where there is such a column (else the
    one with the least coordinates). Ties go to the feature with the smallest `order`.
    """
    radius = min(10.0, max(0.1, radius_km))
    side = 2 * math.sin(radius / EARTH_KM / 2) * (1 + 1e-9)
    cube = lambda lat, lon: [F.floor(x / side) for x in unit_vector(lat, lon)]
    label = F.col("label") if "label" in features.columns else F.lit(None).cast("string")
    mapped = features.filter(valid_coordinate(F.col("lat"), F.col("lon")))
    mapped = mapped.select("osm_type", "osm_id", label.alias("label"), F.col(order).alias("__ord"), F.col("lat").alias("__flat"), F.col("lon").alias("__flon"), *[c.alias(f"__f{k}") for k, c in enumerate(cube(F.col("lat"), F.col("lon")))])
    first = F.struct(*[c for c in (station_order, "lat", "lon") if c in stations.columns])
    unique = stations.filter(valid_coordinate(F.col("lat"), F.col("lon"))).groupBy("callsign").agg(F.min_by(F.struct("lat", "lon"), first).alias("p")).select("callsign", "p.lat", "p.lon")
    around = unique.select("*", *[c.alias(f"__s{k}") for k, c in enumerate(cube(F.col("lat"), F.col("lon")))])
    for k in range(3):
        around = around.withColumn(f"__s{k}", F.explode(F.array(*[F.col(f"__s{k}") + d for d in (-1, 0, 1)])))
    same = [F.col(f"__s{k}") == F.col(f"__f{k}") for k in range(3)]
    near = around.join(mapped, same).withColumn("d", haversine_km(F.col("lat"), F.col("lon"), F.col("__flat"), F.col("__flon"))).filter(F.col("d") <= radius)
    best = near.groupBy("callsign").agg(F.min_by(F.struct("osm_type", "osm_id", "label", "d"), F.struct("d", "__ord")).alias("m")).select("callsign", "m.*")
    return unique.select("callsign").join(best, "callsign", "left").select(
        "callsign", F.col("osm_id").isNotNull().alias("matched"), "osm_type", "osm_id", "label", F.col("d").alias("distance_km"), F.bround(F.col("d") * 1000).cast("long").alias("distance_m"),
        F.when(F.col("d").isNotNull(), osm_strength(F.col("d"))).alias("strength"), F.lit(radius).alias("radius_km"),
    )


def match_stats(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count_if("matched").alias("matched"), F.count(F.lit(1)).alias("total"))
