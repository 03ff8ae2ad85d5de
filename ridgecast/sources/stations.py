"""Station lists, seed tables, override registries, lookup answers and jobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import valid_coordinate
from ..functions.text import coerce_number, normalize_call

STATION = "callsign string, name string, type string, lat double, lon double, comment string, symbol string, lasttime bigint, source string, seed_only boolean"
SEED_CSV = "Callsign string, Lat double, Lon double, Type string, Comment string, Override string, Power_W double, Height_ft double, Gain_dBd double, Dir_deg double"
WRAPPERS = ("stations", "results", "data")
JOB_DEFAULTS = {"mode": "area", "frozen_stations": False}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text; no rows where the path does not exist."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "value string")
        raise


def parse_records(df: DataFrame, text: str = "value", strict: bool = False) -> DataFrame:
    """df's other columns, pos and record (map of key -> variant) of JSON texts: a list of objects, or an object that wraps one under stations, results or data.

    Records keep whatever keys they have; list elements that are no objects are left out. strict: the first of the three that is a list counts, and a text
    without one is an error; otherwise the first key that is present counts and anything else gives no rows.
    """
    whole = F.try_parse_json(text)
    listed = lambda path: F.try_variant_get(whole, path, "array<variant>")
    wrapped = [listed(f"$.{k}") for k in WRAPPERS]
    if strict:
        inner = F.coalesce(*wrapped)
    else:
        there = lambda k: F.try_variant_get(whole, f"$.{k}", "variant").isNotNull()
        inner = F.when(there(WRAPPERS[0]), wrapped[0]).when(there(WRAPPERS[1]), wrapped[1]).otherwise(wrapped[2])
    rows = F.coalesce(listed("$"), inner)
    if strict:
        rows = F.when(rows.isNull(), F.raise_error(F.lit("no station list in the text"))).otherwise(rows)
    each = df.select(*[c for c in df.columns if c != text], F.posexplode(rows).alias("pos", "__v"))
    return each.withColumn("record", F.try_variant_get("__v", "$", "map<string, variant>")).filter("record is not null").drop("__v")


def parse_stations(df: DataFrame, text: str = "value", strict: bool = False) -> DataFrame:
    """Station rows of the catalog's own columns; numbers may be text. Both spellings of source and seed_only count. See parse_records()."""
    records = parse_records(df.select(text), text, strict)
    get = lambda k: F.try_variant_get(F.try_element_at("record", F.lit(k)), "$", "string")
    kinds = {"lat": "double", "lon": "double", "lasttime": "double", "seed_only": "boolean"}
    either = {"source": ("source", "_source"), "seed_only": ("seed_only", "_seed_only")}
    column = lambda c: F.coalesce(*[get(k) for k in either.get(c, (c,))])
    fields = [tuple(field.strip().split(" ")) for field in STATION.split(",")]
    return records.select(*[column(c).try_cast(kinds.get(c, "string")).cast(kind).alias(c) for c, kind in fields])


def open_records_of(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """pos and record of JSON files."""
    return parse_records(read_texts(spark, path), strict=strict)


def read_stations(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return parse_stations(read_texts(spark, path), strict=strict)


def read_stations_lines(spark: SparkSession, path: str) -> DataFrame:
    """Station rows of JSON lines, as write_seed() leaves them."""
    return spark.read.schema(STATION).json(path)


def resolve_seed(user: DataFrame | None, bundled: DataFrame, chosen: bool = False) -> DataFrame:
    """The user's seed if it has rows; an empty one that was chosen stays empty; else the bundled baseline."""
    if user is not None and not user.isEmpty():
        return user
    return bundled.limit(0) if chosen else bundled


def seed_rows(csv: DataFrame) -> DataFrame:
    """The seed table's columns under the catalog's names."""
    more = {"Override": "override", "Power_W": "power_w", "Height_ft": "height_ft", "Gain_dBd": "gain_dbd", "Dir_deg": "dir_deg"}
    return csv.select(
        F.col("Callsign").alias("callsign"), F.lower("Type").alias("type"), F.col("Lat").alias("lat"), F.col("Lon").alias("lon"), F.col("Comment").alias("comment"), *[F.col(c).alias(n) for c, n in more.items() if c in csv.columns],
        F.lit("seed").alias("source"), F.lit(True).alias("seed_only"),
    )


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    return seed_rows(spark.read.schema(SEED_CSV).csv(path, header=True))


def parse_registry(df: DataFrame, text: str = "value") -> DataFrame:
    """Override rows of JSON texts, an object of entries under "overrides" or bare; unreadable texts and entries are skipped."""
    outer = F.from_json(text, "struct<overrides: map<string, string>>")["overrides"]
    entries = F.coalesce(outer, F.from_json(text, "map<string, string>"))
    rows = df.select(F.explode(entries).alias("call", "entry")).filter(F.ltrim("entry").startswith("{"))
    fields = F.from_json("entry", "struct<status: string, lat: double, lon: double, reason: string, source: string, source_url: string>")
    return rows.select(normalize_call(F.col("call")).alias("callsign"), fields.alias("f")).filter("callsign <> ''").select("callsign", "f.*").withColumn("status", F.lower(F.coalesce("status", F.lit("candidate"))))


def parse_lookup(df: DataFrame, text: str = "value") -> DataFrame:
    """Position lookup answers ({entries: [{name, lat, lng, ...}]}) as station rows; rows without usable numbers are skipped."""
    entry = "name: string, lat: string, lng: string, comment: string, symbol: string, lasttime: string, time: string"
    rows = df.select(F.inline(F.from_json(text, f"struct<entries: array<struct<{entry}>>>")["entries"]))
    seen = F.coalesce(F.nullif(F.col("lasttime").try_cast("bigint"), F.lit(0)), F.col("time").try_cast("bigint"))
    rows = rows.select(normalize_call(F.col("name")).alias("callsign"), coerce_number(F.col("lat")).alias("lat"), coerce_number(F.col("lng")).alias("lon"), F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce("symbol", F.lit("")).alias("symbol"), seen.alias("lasttime"), F.lit("aprs.fi").alias("source"))
    return rows.filter("callsign <> '' and lat is not null and lon is not null")


def parse_jobs(df: DataFrame, text: str = "value") -> DataFrame:
    """Job rows with defaults for missing fields."""
    fields = "region: struct<center_lat: double, center_lon: double, radius_km: double>, station_source: string, include_types: array<string>, propagation_radius_km: double, mode: string, frozen_stations: boolean, radio_settings: map<string, double>"
    job = df.select(F.from_json(text, f"struct<{fields}>").alias("j")).select("j.*")
    return job.select(
        F.col("region.center_lat").alias("center_lat"), F.col("region.center_lon").alias("center_lon"), F.col("region.radius_km").alias("radius_km"), "station_source", F.coalesce("include_types", F.array(F.lit("digi"), F.lit("igate"))).alias("include_types"),
        "propagation_radius_km", F.coalesce("mode", F.lit(JOB_DEFAULTS["mode"])).alias("mode"), F.coalesce("frozen_stations", F.lit(JOB_DEFAULTS["frozen_stations"])).alias("frozen_stations"), F.coalesce("radio_settings", F.expr("cast(map() as map<string, double>)")).alias("radio_settings"),
    )


def parse_features(df: DataFrame, text: str = "value") -> DataFrame:
    """Mapped features ({elements: [...]}): own point or centre, an integer id, on the globe; the first of each (type, id) counts."""
    from pyspark.sql import Window

    from ..functions.trust import osm_label

    element = "type: string, id: string, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>"
    each = df.withColumn("__doc", F.monotonically_increasing_id()).select("__doc", F.posexplode(F.from_json(text, f"struct<elements: array<struct<{element}>>>")["elements"]).alias("pos", "e"))
    rows = each.select(
        "__doc", "pos", F.col("e.type").alias("osm_type"), F.col("e.id").try_cast("bigint").alias("osm_id"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce("e.tags", F.expr("cast(map() as map<string, string>)")).alias("tags"),
    )
    rows = rows.filter(F.col("osm_id").isNotNull() & valid_coordinate(F.col("lat"), F.col("lon")))
    first = Window.partitionBy("osm_type", "osm_id").orderBy("__doc", "pos")
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "__doc", "pos").withColumn("label", osm_label(F.col("tags")))
