"""Registered queries of the end-to-end grid plans: every site of the catalog, every ray, with the whole chain in SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import queries as batch
from ..fixtures import fixture
from ..operators import catalog, coverage, rays
from ..operators.rays import Geometry
from ..sources import sinks
from ..sources.grids import Grid, grid_of, write_grid
from ..sources.scratch import scratch
from . import area

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: SQL that takes minutes beyond the smallest tables, on which the tests hold these queries against it.
TEST_SQL: dict[str, str] = {}

#: At a radius of 12 cells 120 points keep the 40 loss samples of a ray apart.
WIDE = Geometry(1080, 120, 12.0, 12_000.0)
#: A second geometry: fewer rays, a shorter radius.
NARROW = Geometry(360, 60, 6.0, 6_000.0)
#: Antenna heights of digipeaters, gateways and mobile stations.
HEIGHTS, LOW_HEIGHTS = (20.0, 3.0, 2.0), (6.0, 9.0, 1.5)
#: The grid's corner in zone 12 and its least cell, so that it covers the stations' region.
EASTING0, NORTHING0, ZONE = 135_000.0, 4_720_000.0, 12


def dem_grid(v) -> Grid:
    """The elevation view as a stored grid, stretched over the stations' region."""
    height = batch._height(v)
    cell_m = max(600_000.0 / 100, 690_000.0 / height)
    dem = v("fx_dem")
    return write_grid(grid_of(dem, height, 100, easting0=EASTING0, northing0=NORTHING0, cell_m=cell_m, zone=ZONE), scratch(dem.sparkSession, "grid"))


def placed(v) -> DataFrame:
    return catalog.merge_records(v("fx_stations_raw")).filter("lat is not null and lon is not null").select("callsign", "type", "lat", "lon")


def frozen_sites(v, grid: Grid) -> DataFrame:
    """The sites of a run, written once: every later step reads exactly these."""
    found = area.sites_on_grid(placed(v), grid, v("fx_dem"))
    return sinks.freeze_stations(found, scratch(found.sparkSession, "sites"), "run")


def profiles_of(v) -> DataFrame:
    """The radio profiles; odd ones have other antennas and shorter rays."""
    odd = F.col("profile_id") % 2 == 1
    pick = lambda a, b: F.when(odd, F.lit(b)).otherwise(F.lit(a))
    fields = {
        "digi_height_m": pick(HEIGHTS[0], LOW_HEIGHTS[0]), "igate_height_m": pick(HEIGHTS[1], LOW_HEIGHTS[1]), "target_height_m": pick(HEIGHTS[2], LOW_HEIGHTS[2]),
        "n_radials": pick(WIDE.n_radials, NARROW.n_radials), "points": pick(WIDE.points, NARROW.points), "radius_px": pick(WIDE.radius_px, NARROW.radius_px), "radius_m": pick(WIDE.radius_m, NARROW.radius_m),
    }
    return area.radio_profiles(v("fx_profiles").withColumns(fields), floor_db=0.0, max_db=60.0, gap_factor=0.25)


def _heights(h: tuple[float, float, float]) -> dict:
    return dict(zip(("digi_height", "igate_height", "target_height"), h, strict=True))


_SITES = f"""{batch._MERGE}, shared as (select min(callsign) as site from merged where lat is not null and lon is not null group by round(lat, 4), round(lon, 4)),
own as (select callsign as site, type, lat, lon from merged where callsign in (select site from shared)), {batch._sql_forward("own", ZONE)}, cell as (select greatest(6000e0, 690000e0 / (max(r) + 1)) as m from fx_dem),
spots as (select site, type, cast(floor((easting - {EASTING0}) / m) as int) as c, cast(floor(({NORTHING0} - northing) / m) as int) as r from en, cell),
sites as (select site, type, s.r, s.c, elev_m as site_elev from spots s join fx_dem d on d.r = s.r and d.c = s.c where elev_m is not null),
dem as (select r * 1000 + c as at, elev_m from fx_dem), size as (select max(r) as bottom from fx_dem)"""


def _sql_losses(name: str, g: Geometry, heights: tuple[float, float, float], model: str) -> str:
    """Tables {name}_rays (site, radial, losses: a list from the nearest sample) and {name} (site, r, c, loss)."""
    n, at, dist = g.points, g.sample_points(), g.sample_distances()
    bend = "0.8e0 / (2 * 6371000e0)"
    base = "case when clear then -20e0 else 30e0 end" if model == "los" else "32.45e0 + 20 * log10(greatest(d, 1e0) / 1000) + case when clear then 0e0 else 30e0 end"
    places = []
    for step in range(1, n + 1):
        x = step * (g.radius_m / (n + 1))
        low = max([k for k, d in enumerate(dist) if d <= x], default=0)
        share = (x - dist[low]) / (dist[low + 1] - dist[low]) if x > dist[low] and low + 1 < len(dist) else 0.0
        places.append(f"({step}, {low + 1}, {share!r}::double, {x / g.radius_m * g.radius_px!r}::double)")
    turn = f"radians(radial * 360e0 / {g.n_radials})"
    return f"""{name}_0 as (select site, r, c, site_elev, site_elev + case when type = 'digi' then {heights[0]}e0 else {heights[1]}e0 end as top, cast(unnest(range(0, {g.n_radials})) as int) as radial from sites),
{name}_1 as (select *, cast(unnest(range(1, {n + 1})) as int) as k from {name}_0),
{name}_2 as (select site, radial, k, site_elev, top, k / {n}e0 * {g.radius_m}e0 as d, round(r + k / {n}e0 * ((r - {g.radius_px} * cos({turn})) - r), 9) as fr, round(c + k / {n}e0 * ((c + {g.radius_px} * sin({turn})) - c), 9) as fc from {name}_1),
{name}_3 as (select *, cast(least(greatest(floor(fr), 0), greatest(bottom - 1, 0)) as int) as r0, cast(least(greatest(floor(fc), 0), 98) as int) as c0 from {name}_2, size where fr >= 0 and fr <= bottom and fc >= 0 and fc <= 99),
{name}_4 as (select site, radial, k, site_elev, top, d, (1 - (fr - r0)) * ((1 - (fc - c0)) * a.elev_m + (fc - c0) * b.elev_m) + (fr - r0) * ((1 - (fc - c0)) * p.elev_m + (fc - c0) * q.elev_m) as elev
 from {name}_3 left join dem a on a.at = r0 * 1000 + c0 left join dem b on b.at = r0 * 1000 + c0 + 1 left join dem p on p.at = r0 * 1000 + c0 + 1000 left join dem q on q.at = r0 * 1000 + c0 + 1001),
{name}_5 as (select site, radial, k, top, d, coalesce(last_value(elev ignore nulls) over (partition by site, radial order by k rows unbounded preceding), site_elev) as elev, max(d) over (partition by site, radial) as far from {name}_4),
{name}_6 as (select site, radial, k, d, far, coalesce(max((elev - top) / d - d * {bend}) over (partition by site, radial order by k rows between unbounded preceding and 1 preceding) <= (elev + {heights[2]}e0 - top) / d - d * {bend}, true) as clear from {name}_5),
{name}_rays as materialized (select site, radial, list({base} order by k) as losses from {name}_6 where far >= 100 and k in ({", ".join(map(str, at))}) group by site, radial),
{name}_7 as (select site, radial, step, px, case when low >= len(losses) then losses[len(losses)] else losses[low] + (losses[low + 1] - losses[low]) * share end as loss from {name}_rays, (values {", ".join(places)}) s(step, low, share, px)),
{name} as materialized (select x.site, cast(round_even(round(s.r - px * cos({turn}), 9), 0) as int) as r, cast(round_even(round(s.c + px * sin({turn}), 9), 0) as int) as c, min(loss) as loss from {name}_7 x join sites s using (site), size
 where round_even(round(s.r - px * cos({turn}), 9), 0) between 0 and bottom and round_even(round(s.c + px * sin({turn}), 9), 0) between 0 and 99 group by 1, 2, 3)"""


def _sql_finish(hits: str, reach: int) -> str:
    """Gap-filled, smoothed, thresholded cells of grids (site, r, c, margin_db, max_db) of the table hits, floor 0: the table finished."""
    beyond = reach + coverage.blur_radius(reach)
    return f"""{hits}, painted as (select site, r, c, max(margin_db) as margin_db from hits group by 1, 2, 3), tops as (select site, max(max_db) as max_db from hits group by 1),
box as (select site, greatest(min(r) - {beyond}, 0) as r1, least(max(r) + {beyond}, any_value(bottom)) as r2, greatest(min(c) - {beyond}, 0) as c1, least(max(c) + {beyond}, 99) as c2 from painted, size group by site),
rws as (select site, unnest(range(r1, r2 + 1)) as r, c1, c2 from box), cls as (select site, r, unnest(range(c1, c2 + 1)) as c from rws),
dense as (select g.site, cast(g.r as int) as r, cast(g.c as int) as c, coalesce(p.margin_db, 0) as margin_db from cls g left join painted p on p.site = g.site and p.r = g.r and p.c = g.c),
rowmax as (select *, max(margin_db) over (partition by site, r order by c range between {reach} preceding and {reach} following) as m from dense),
filled as (select site, r, c, case when margin_db = 0 then max(m) over (partition by site, c order by r range between {reach} preceding and {reach} following) else margin_db end as margin_db from rowmax),
start as (select f.site, f.r, f.c, b.r1, b.r2, b.c1, b.c2, f.margin_db, case when f.margin_db = 0 then -1e0 else f.margin_db end as v from filled f join box b on b.site = f.site),
{batch._sql_blur("start", "down", "c", "r")}, {batch._sql_blur("down", "across", "r", "c")},
finished as (select a.site, r, c, least(v, max_db) as margin_db from across a join tops using (site) where margin_db <> 0 and v >= 0)"""


def site_grids(v) -> DataFrame:
    grid = dem_grid(v)
    sites = frozen_sites(v, grid)
    cells = area.site_grids(sites, grid, WIDE, 138.0, 144.39, max_db=80.0, model="fspl_los", **_heights(HEIGHTS))
    return cells.withColumn("margin_db", F.round("margin_db", 6))


def _hits(losses: str, offset: str, max_db: float) -> str:
    return f"hits as (select site, r, c, {offset} - loss as margin_db, {max_db}e0 as max_db from {losses} where {offset} - loss > 0 union all select site, r, c, {max_db}e0, {max_db}e0 from sites)"


SQL["site_grids"] = f"""with {_SITES}, {_sql_losses("lost", WIDE, HEIGHTS, "fspl_los")}, {_sql_finish(_hits("lost", "(138e0 - 20 * log10(144.39e0))", 80.0), 2)}
select site, r, c, round(margin_db, 6) as margin_db from finished"""


def merged_coverage(v) -> DataFrame:
    """How many distinct grids cover each cell; call signs at one site share its grid."""
    grid = dem_grid(v)
    sites = frozen_sites(v, grid)
    return area.run_coverage(sites, area.one_profile(sites, WIDE, 138.0, 144.39, **_heights(HEIGHTS)), grid)


SQL["merged_coverage"] = f"""with {_SITES}, {_sql_losses("lost", WIDE, HEIGHTS, "los")}, {_sql_finish(_hits("lost", "0e0", 60.0), 2)}
select r, c, count(*) as n_sites from finished where margin_db > 0 group by r, c"""


def scenario_grid(v) -> DataFrame:
    """Every finished cell of every site's grid under every profile."""
    grid = dem_grid(v)
    sites = frozen_sites(v, grid)
    return area.scenario_grids(sites, profiles_of(v), grid, digits=6)


_BUDGET = "case when tx_power_dbm <> 0 or tx_gain_dbd <> 0 or rx_sens_dbm <> 0 or rx_gain_dbd <> 0 then least(tx_power_dbm + abs(rx_sens_dbm) + tx_gain_dbd + rx_gain_dbd, cap_db) else cap_db end - 20 * log10(freq_mhz)"
_SCENARIO_HITS = """told as (select profile_id, {budget} as off from fx_profiles), lost as (select 0 as odd, * from wide union all select 1, * from narrow),
hits as (select site || ':' || profile_id as site, r, c, off - loss as margin_db, 60e0 as max_db from lost join told on profile_id % 2 = odd where off - loss > 0 union all select site || ':' || profile_id, r, c, 60e0, 60e0 from sites, told)"""
TEST_SQL["scenario_grid"] = f"""with {_SITES}, {_sql_losses("wide", WIDE, HEIGHTS, "fspl_los")}, {_sql_losses("narrow", NARROW, LOW_HEIGHTS, "fspl_los")}, {_sql_finish(_SCENARIO_HITS.format(budget=_BUDGET), 2)}
select split_part(site, ':', 1) as site, cast(split_part(site, ':', 2) as bigint) as profile_id, r, c, round(margin_db, 6) as margin_db from finished"""


def zero_coverage(v) -> DataFrame:
    grid = dem_grid(v)
    sites = frozen_sites(v, grid)
    found = area.zero_coverage(sites, grid, v("fx_dem"), WIDE, 60.0, 144.39, -100.0, **_heights(HEIGHTS))
    return found.select("site", "n_rays", F.round("first_ray_loss_db", 6).alias("first_ray_loss_db"), "elev_m", "neighbours", "median_m", "drop_m", "warnings")


SQL["zero_coverage"] = f"""with {_SITES}, {_sql_losses("lost", WIDE, HEIGHTS, "fspl_los")}, off as (select 60e0 - 20 * log10(144.39e0) as off),
stats as (select site, count(*) filter (off - list_min(losses) >= -100) as n_rays, count(*) filter (off - list_min(losses) > 0) as n_covered, arg_min(losses[len(losses)], radial) as last from lost_rays, off group by site),
near as (select site, d.elev_m, d.r = s.r and d.c = s.c as centre from sites s join fx_dem d on abs(d.r - s.r) <= 2 and abs(d.c - s.c) <= 2),
pits as (select site, max(elev_m) filter (centre) as elev_m, count(elev_m) filter (not centre) as neighbours, median(elev_m) filter (not centre) as median_m from near group by site)
select site, n_rays, round(last + 20 * log10(144.39e0), 6) as first_ray_loss_db, elev_m, neighbours, median_m, case when neighbours >= 4 then median_m - elev_m end as drop_m, case when neighbours >= 4 and median_m - elev_m > 40 then 'pit' else '' end as warnings
from stats join pits using (site) where n_covered = 0"""


def ray_profiles(v) -> DataFrame:
    """Every ray's terrain: how far it goes, its highest and its last elevation."""
    grid = dem_grid(v)
    standing = area.with_stands(frozen_sites(v, grid))
    stands = standing.groupBy(F.col("stand").alias("site")).agg(*[F.first(c).alias(c) for c in ("r", "c", "site_elev")])
    laid = rays.profiles(stands, grid, WIDE).withColumnRenamed("site", "stand")
    found = laid.select("stand", "radial", F.size("elev_m").alias("n"), F.round(F.array_max("elev_m"), 3).alias("highest"), F.round(F.element_at("elev_m", -1), 3).alias("last"))
    return standing.select("site", "stand").join(found, "stand").drop("stand")


_profile_sql = _sql_losses("lost", WIDE, HEIGHTS, "los")
TEST_SQL["ray_profiles"] = f"""with {_SITES}, {_profile_sql[: _profile_sql.index(",\nlost_6 as")]}
select site, radial, cast(count(*) as int) as n, round(max(elev), 3) as highest, round(arg_max(elev, k), 3) as last from lost_5 where far >= 100 group by site, radial"""


def _register() -> None:
    for function in (site_grids, merged_coverage, scenario_grid, zero_coverage, ray_profiles):
        QUERIES[function.__name__] = lambda spark, sf_dir, run=function: run(lambda view: fixture(spark, sf_dir, view))
    for found in (SQL, TEST_SQL):
        found.update({name: batch.with_views(sql) for name, sql in found.items()})


_register()
