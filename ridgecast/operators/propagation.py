"""Line of sight, path loss, link margin and painting along rays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.radio import fspl_db

EARTH_M = 6_371_000.0
CURVATURE = 0.8
CLEAR_DB, BLOCKED_DB, BLOCKED_EXTRA_DB = 20.0, 30.0, 30.0
NEAREST_M = 500.0
SHORTEST_M = 100.0


def line_of_sight(profiles: DataFrame, site_height: float, target_height: float) -> DataFrame:
    """profiles with clear: whether each point's antenna sees the site's over the curved terrain between.

    With a(d) = (h(d) - H0) / d - d k / 2R the pairwise test "every interior point lies below the ray" becomes one running
    maximum: a target at D is seen if max a(d < D) <= (Ht - H0) / D - D k / 2R.
    """
    bend = CURVATURE / (2 * EARTH_M)
    top = F.col("site_elev") + site_height
    d = F.col("dist_m")
    before = Window.partitionBy("site", "radial").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    slope = (F.col("elev_m") - top) / d - d * bend
    target = (F.col("elev_m") + target_height - top) / d - d * bend
    return profiles.withColumn("__a", slope).withColumn("clear", F.coalesce(F.max("__a").over(before) <= target, F.lit(True))).drop("__a")


def min_range(profiles: DataFrame, shortest_m: float = SHORTEST_M) -> DataFrame:
    """Points of the rays that reach at least so far."""
    ray = Window.partitionBy("site", "radial")
    return profiles.withColumn("__far", F.max("dist_m").over(ray)).filter(F.col("__far") >= shortest_m).drop("__far")


def sample_schedule(radius_m: float, n: int = 40) -> list[float]:
    """Distances at which the loss is evaluated: a third close in, the rest out to the radius."""
    near = max(3, n // 3)
    low, high = max(NEAREST_M, 0.01 * radius_m), 0.2 * radius_m
    high = max(low, high)
    return [low + (high - low) * i / near for i in range(1, near + 1)] + [high + (radius_m - high) * i / (n - near) for i in range(1, n - near + 1)]


def samples(profiles: DataFrame, radius_m: float, points: int, n: int = 40) -> DataFrame:
    """The profile point nearest to each scheduled distance: profile columns and sample number j."""
    spark = profiles.sparkSession
    at = {}
    for j, d in enumerate(sample_schedule(radius_m, n)):
        at.setdefault(min(points, max(1, round(d / radius_m * points))), j)
    wanted = spark.createDataFrame(sorted(at.items()), "k int, j int")
    return profiles.join(F.broadcast(wanted), "k")


def path_loss(points: DataFrame, budget: Column, freq_mhz: Column, model: str | Callable = "los") -> DataFrame:
    """points (with clear, dist_m) with loss_db and margin_db.

    los: clear points end 20 dB under the budget, blocked ones 30 dB over. fspl_los: free-space loss, 30 dB more when blocked (an
    extension). A function gets one ray as a pandas frame (with budget_db, freq_mhz) and returns its losses.
    """
    rows = points.withColumns({"budget_db": budget, "freq_mhz": freq_mhz})
    if callable(model):
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", loss_db double"

        def one(ray):
            ray = ray.sort_values("k")
            return ray.assign(loss_db=model(ray))

        rows = rows.groupBy("site", "radial").applyInPandas(one, schema)
    elif model == "los":
        rows = rows.withColumn("loss_db", F.when(F.col("clear"), F.col("budget_db") - CLEAR_DB).otherwise(F.col("budget_db") + BLOCKED_DB))
    elif model == "fspl_los":
        rows = rows.withColumn("loss_db", fspl_db(F.col("dist_m"), F.col("freq_mhz")) + F.when(F.col("clear"), 0.0).otherwise(BLOCKED_EXTRA_DB))
    else:
        raise ValueError(f"no such model: {model}")
    return rows.withColumn("margin_db", F.col("budget_db") - F.col("loss_db"))


def useful_radials(margins: DataFrame, floor_db: float) -> DataFrame:
    """Samples of the rays whose best sample reaches the floor."""
    ray = Window.partitionBy("site", "radial")
    return margins.withColumn("__best", F.max("margin_db").over(ray)).filter(F.col("__best") >= floor_db).drop("__best")


def interpolate_margin(margins: DataFrame, radius_m: float, steps: int) -> DataFrame:
    """site, radial, step, dist_m, margin_db at evenly spaced distances, linear between samples and constant beyond the outer ones.

    Each sample is paired with its successor and explodes the steps inside its own interval, so nothing is joined.
    """
    ray = Window.partitionBy("site", "radial").orderBy("dist_m")
    width = radius_m / (steps + 1)
    rows = margins.select("site", "radial", "dist_m", "margin_db", F.lead("dist_m").over(ray).alias("d2"), F.lead("margin_db").over(ray).alias("m2"), F.row_number().over(ray).alias("n"))
    first = F.when(F.col("n") == 1, F.lit(1)).otherwise(F.ceil(F.col("dist_m") / width).cast("int"))
    last = F.when(F.col("d2").isNull(), F.lit(steps)).otherwise((F.ceil(F.col("d2") / width) - 1).cast("int"))
    rows = rows.withColumns({"a": first, "b": F.least(last, F.lit(steps))}).filter("a <= b").withColumn("step", F.explode(F.sequence("a", "b")))
    x = F.col("step") * width
    inside = F.col("margin_db") + (F.col("m2") - F.col("margin_db")) * (x - F.col("dist_m")) / (F.col("d2") - F.col("dist_m"))
    return rows.select("site", "radial", "step", x.alias("dist_m"), F.when(F.col("d2").isNull() | (x <= F.col("dist_m")), F.col("margin_db")).otherwise(inside).alias("margin_db"))


def paint(steps: DataFrame, sites: DataFrame, n_radials: int, radius_px: float, radius_m: float, floor_db: float, max_db: float, height: int, width: int) -> DataFrame:
    """site, r, c, margin_db: the best margin over all rays in each cell; the site's own cell has the highest possible one.

    Under a negative floor the true negative margins are painted too (coverage counts only positive ones).
    """
    shown = steps.filter(F.col("margin_db") > floor_db).join(sites.select("site", F.col("r").alias("r0"), F.col("c").alias("c0")), "site")
    angle, px = F.radians(F.col("radial") * 360.0 / n_radials), F.col("dist_m") / radius_m * radius_px
    hit = F.struct(F.rint(F.col("r0") - px * F.cos(angle)).cast("int").alias("r"), F.rint(F.col("c0") + px * F.sin(angle)).cast("int").alias("c"), "margin_db", F.lit(False).alias("own"))
    own = F.struct(F.col("r0").alias("r"), F.col("c0").alias("c"), F.lit(float(max_db)).alias("margin_db"), F.lit(True).alias("own"))
    # Every hit brings its site's own cell along, which the partial aggregation takes in, rather than computing the rays a second time for it.
    cells = shown.select("site", F.inline(F.array(hit, own))).filter(F.col("own") | (F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))).drop("own")
    return paint_max(cells, min(floor_db, 0.0))


def paint_max(hits: DataFrame, floor_db: float = 0.0) -> DataFrame:
    """The largest margin over the floor of each site and cell."""
    return hits.filter(F.col("margin_db") > floor_db).groupBy("site", "r", "c").agg(F.max("margin_db").alias("margin_db"))


def radial_stats(margins: DataFrame, n_radials: int, floor_db: float) -> DataFrame:
    """site, n_rays, n_covered, pct."""
    rays = margins.groupBy("site", "radial").agg(F.max("margin_db").alias("best"))
    return rays.groupBy("site").agg(F.count_if(F.col("best") >= floor_db).alias("n_rays"), F.count_if(F.col("best") > 0).alias("n_covered")).withColumn("pct", F.col("n_covered") * 100.0 / n_radials)


def zero_coverage(stats: DataFrame, pits: DataFrame, margins: DataFrame) -> DataFrame:
    """Sites with rays but no covered one: elevation, neighbour median, pit drop and the loss at their first ray's end."""
    first = margins.groupBy("site").agg(F.max_by("loss_db", F.struct(-F.col("radial"), F.col("dist_m"))).alias("first_ray_loss_db"))
    return stats.filter("n_covered = 0").select("site", "n_rays").join(pits, "site", "left").join(first, "site", "left")
