"""What a job leaves behind, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.radio import antenna_height
from ..functions.text import escape_text, station_label

USABLE = ("digi", "igate")


def usable_stations(df: DataFrame) -> DataFrame:
    return df.filter(F.col("type").isin(*USABLE) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def catalog_table(df: DataFrame, updated_at: int, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Usable stations with the catalog's stamp on each row."""
    return usable_stations(df).withColumns({"updated_at": F.lit(updated_at).cast("long"), "center_lat": F.lit(lat), "center_lon": F.lit(lon), "radius_km": F.lit(radius_km)})


def write_catalog(df: DataFrame, path: str, **stamp) -> None:
    catalog_table(df, **stamp).write.mode("overwrite").parquet(path)


def write_seed(df: DataFrame, metadata: DataFrame, path: str) -> None:
    """Stations in call sign order and the session's metadata."""
    df.orderBy("callsign").write.mode("overwrite").json(f"{path}/stations")
    metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_margin_grid(cells: DataFrame, path: str) -> None:
    """Per-site margin cells; a site's partition replaces its former one."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(path)


def write_coverage(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").parquet(path)


def freeze_stations(df: DataFrame, path: str, job_id: str) -> DataFrame:
    """Write the reviewed set of a job and read exactly that back."""
    df.write.mode("overwrite").parquet(f"{path}/job_id={job_id}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/job_id={job_id}")


def map_features(stations: DataFrame, overlays: DataFrame | None = None, digi_height: float = 10.0, igate_height: float = 10.0, freq_mhz: float = 144.39, budget_db: float = 138.0) -> DataFrame:
    """One map feature for each station: group, style, sidebar label, description (a line for each field), place and, where its site has one, the overlay's box.

    overlays: callsign, south, north, west, east (coverage.overlay_bounds() of the site's grid); stations without one have nulls there.
    """
    kind, comment = F.col("type"), F.nullif(F.coalesce(F.col("comment"), F.lit("")), F.lit(""))
    seen = F.col("lasttime") if "lasttime" in stations.columns else F.lit(None).cast("long")
    height = antenna_height(kind, F.lit(float(digi_height)), F.lit(float(igate_height)))
    lines = {
        "Callsign": F.col("callsign"), "Type": F.when(kind == "digi", "Digipeater").otherwise("iGate"), "Frequency": F.format_string("%.3f MHz", F.lit(freq_mhz)), "Coordinates": F.format_string("%.5f, %.5f", "lat", "lon"),
        "Antenna": F.format_string("%.0f m over ground", height), "Link budget": F.format_string("%.1f dB", F.lit(budget_db)), "Comment": F.coalesce(escape_text(comment), F.lit("-")), "Last seen": F.coalesce(F.nullif(seen, F.lit(0)).cast("string"), F.lit("-")),
    }
    rows = stations.select(
        "callsign", F.when(kind == "digi", "Digipeaters").otherwise("iGates").alias("folder"), F.when(kind == "digi", "style_digi").otherwise("style_igate").alias("style"),
        station_label(kind, F.col("callsign"), F.col("comment")).alias("label"), F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("-"))) for k, v in lines.items()]).alias("description"), "lon", "lat",
    )
    return rows if overlays is None else rows.join(overlays.select("callsign", "south", "north", "west", "east"), "callsign", "left")


def segment_lines(segments: DataFrame) -> DataFrame:
    """Hit and miss line strings (segments: ..., is_hit, points)."""
    from .tracks import line_text

    return segments.select(*[c for c in segments.columns if c != "points"], F.when(F.col("is_hit"), "hit").otherwise("miss").alias("style"), line_text(F.col("points")).alias("coordinates"))
