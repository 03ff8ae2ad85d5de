"""A store of finished grids by site and radio profile, so that a run computes only what no run before it has.

Two tables: cells, partitioned by profile, and done, a row for each grid that was written in full. A profile's key is a digest of everything that shapes its
grids; a site's is a digest of its place and type, so a site that moves is computed anew. Cells carry their batch and count only where done names it, so what a
failed run left behind is never read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.grids import Grid
from .area import PROFILE, scenario_grids

DONE = "site string, place string, profile string, batch string"
CELLS = "site string, r int, c int, margin_db double, batch string, profile string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def profile_key(model: str):
    fields = [f.strip().split(" ")[0] for f in PROFILE.split(",")]
    return F.sha2(F.concat(F.lit(f"{model}|"), F.to_json(F.struct(*[f for f in fields if f != "profile_id"]))), 256)


def pairs_of(sites: DataFrame, profiles: DataFrame, model: str) -> DataFrame:
    """site, place, profile_id, profile: every grid that sites and profiles ask for (a job's profiles, some hundred bytes each, go into the plan)."""
    known = [(r["profile_id"], r["key"]) for r in profiles.select("profile_id", profile_key(model).alias("key")).collect()]
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("profile_id"), F.lit(k).alias("profile")) for i, k in known])
    place = F.sha2(F.to_json(F.struct("type", "r", "c", "site_elev")), 256)
    rows = sites.select(F.col("site").cast("string").alias("site"), place.alias("place"))
    return rows.select("*", F.inline(each)) if known else rows.select("*", F.lit(0).cast("long").alias("profile_id"), F.lit("").alias("profile")).limit(0)


def missing_grids(sites: DataFrame, profiles: DataFrame, path: str, model: str = "fspl_los") -> DataFrame:
    """Pairs that the store at path lacks."""
    return pairs_of(sites, profiles, model).join(_read(sites.sparkSession, f"{path}/done", DONE), ["site", "place", "profile"], "left_anti")


def stored_grids(sites: DataFrame, profiles: DataFrame, grid: Grid, path: str, model: str = "fspl_los") -> DataFrame:
    """site (as text), profile_id, r, c, margin_db of all sites under all profiles; grids that the store at path lacks are computed and added to it first."""
    spark, batch = sites.sparkSession, uuid.uuid4().hex
    listed = f"{path}/wanted/{batch}"
    missing_grids(sites, profiles, path, model).write.parquet(listed)  # what this run adds, as it stood before
    wanted = spark.read.parquet(listed)
    if not wanted.isEmpty():
        own = F.col("site").cast("string")
        some = sites.join(wanted.select(F.col("site").alias("__w")).distinct(), own == F.col("__w"), "left_semi")
        asked = profiles.join(wanted.select(F.col("profile_id").alias("__p")).distinct(), F.col("profile_id") == F.col("__p"), "left_semi")
        made = scenario_grids(some, asked, grid, model).withColumn("site", own)
        cells = made.join(wanted.select("site", "profile_id", "profile"), ["site", "profile_id"]).select("site", "r", "c", "margin_db", F.lit(batch).alias("batch"), "profile")
        cells.dropDuplicates(["site", "profile", "r", "c"]).write.mode("append").partitionBy("profile").parquet(f"{path}/cells")
        wanted.select("site", "place", "profile", F.lit(batch).alias("batch")).distinct().write.mode("append").parquet(f"{path}/done")
    done = pairs_of(sites, profiles, model).join(_read(spark, f"{path}/done", DONE), ["site", "place", "profile"])
    return _read(spark, f"{path}/cells", CELLS).join(done, ["site", "profile", "batch"]).select("site", "profile_id", "r", "c", "margin_db")
