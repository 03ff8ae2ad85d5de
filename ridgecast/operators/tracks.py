"""Checking predicted coverage against recorded tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_DEGREES = 0.02


def in_bounds(track: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """track with inside."""
    return track.withColumn("inside", F.col("lat").between(south, north) & F.col("lon").between(west, east))


def sample_track(track: DataFrame, coverage: DataFrame, north: float, west: float, step: float) -> DataFrame:
    """track with the coverage value of its cell (0 where there is none) and is_hit."""
    rows = track.withColumns({"r": F.floor((north - F.col("lat")) / step).cast("int"), "c": F.floor((F.col("lon") - west) / step).cast("int")})
    rows = rows.join(coverage.select("r", "c", F.col("n_sites").alias("value")), ["r", "c"], "left")
    return rows.withColumn("value", F.coalesce("value", F.lit(0))).withColumn("is_hit", F.col("value") > 0)


def validation_stats(sampled: DataFrame) -> DataFrame:
    """total, outside, hits, misses, accuracy_pct over all points (outside ones count as neither)."""
    inside = F.col("inside")
    stats = sampled.agg(F.count(F.lit(1)).alias("total"), F.count_if(~inside).alias("outside"), F.count_if(inside & F.col("is_hit")).alias("hits"), F.count_if(inside & ~F.col("is_hit")).alias("misses"))
    return stats.withColumn("accuracy_pct", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") * 100.0 / (F.col("hits") + F.col("misses"))).otherwise(0.0))


def segment_track(points: DataFrame) -> DataFrame:
    """track_id, segment, is_hit, points (ordered lon, lat): runs of equal flags without gaps, of more than one point.

    Where only the flag flips, the new point also ends the old segment, so that the lines meet.
    """
    along = Window.partitionBy("track_id").orderBy("ord")
    before = F.lag(F.struct("lat", "lon", "is_hit")).over(along)
    rows = points.withColumn("p", before)
    gap = F.sqrt((F.col("lat") - F.col("p.lat")) * (F.col("lat") - F.col("p.lat")) + (F.col("lon") - F.col("p.lon")) * (F.col("lon") - F.col("p.lon"))) >= GAP_DEGREES
    flip = F.col("is_hit") != F.col("p.is_hit")
    rows = rows.withColumns({"gap": F.coalesce(gap, F.lit(False)), "flip": F.coalesce(flip, F.lit(False))})
    rows = rows.withColumn("segment", F.sum((F.col("gap") | F.col("flip")).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = F.struct(F.col("segment").alias("segment"), F.col("is_hit").alias("is_hit"))
    old = F.struct((F.col("segment") - 1).alias("segment"), F.col("p.is_hit").alias("is_hit"))
    placed = rows.select("track_id", "ord", "lat", "lon", F.inline(F.array_compact(F.array(own, F.when(F.col("flip") & ~F.col("gap"), old)))))
    lines = placed.groupBy("track_id", "segment", "is_hit").agg(F.array_sort(F.collect_list(F.struct("ord", "lon", "lat"))).alias("points"))
    return lines.filter(F.size("points") > 1)


def validate_track(track: DataFrame, coverage: DataFrame, north: float, west: float, step: float, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(statistics, segments) of a track (track_id, ord, lat, lon) against a coverage grid; box: south, north, west, east."""
    sampled = sample_track(in_bounds(track, *box), coverage, north, west, step)
    return validation_stats(sampled), segment_track(sampled.filter("inside"))
