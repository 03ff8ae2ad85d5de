"""Recorded GPS tracks in KML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import coerce_number


def kml_points(df: DataFrame, text: str = "kml") -> DataFrame:
    """df's other columns, k and (lon, lat): first the tuples of <coordinates> blocks, then <gx:coord> elements; bad numbers dropped."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<coordinates>(.*?)</coordinates>"), 1)
    tuples = F.filter(F.flatten(F.transform(blocks, lambda b: F.split(F.trim(F.regexp_replace(b, r"\s+", " ")), " "))), lambda x: x != "")
    single = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<gx:coord>(.*?)</gx:coord>"), 1), lambda b: F.regexp_replace(F.trim(F.regexp_replace(b, r"\s+", " ")), " ", ","))
    others = [c for c in df.columns if c != text]
    rows = df.select(*others, F.posexplode(F.concat(tuples, single)).alias("k", "t")).withColumn("p", F.split("t", ","))
    return rows.select(*others, "k", coerce_number(F.get("p", F.lit(0))).alias("lon"), coerce_number(F.get("p", F.lit(1))).alias("lat")).filter("lon is not null and lat is not null")


def line_text(points: Column) -> Column:
    """A segment's points as KML coordinates."""
    return F.array_join(F.transform(points, lambda p: F.concat(p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(",0"))), " ")
