"""Rays around sites as arrays: terrain, sight and loss along each ray in one row, cells only where something is painted.

A site's window of the grid comes as blocks; one vectorised function for each site lays the rays over it, so that the points of profiles are entries of a
matrix and never rows. What leaves it is one row for each ray (whether the antenna at each scheduled distance sees the site's) or for each painted cell.

A view is a pair of antenna heights. All budgets and frequencies share a view's painted losses: a cell's margin is an offset less its least loss,
so profiles that differ in nothing else are told apart after painting.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.grids import BLOCK, Grid, windows
from .propagation import BLOCKED_DB, BLOCKED_EXTRA_DB, CLEAR_DB, CURVATURE, EARTH_M, SHORTEST_M, sample_schedule

#: Rays whose points are laid out at once.
AT_ONCE = 256
#: Points of rays that a task lays out, and the most tasks; work grows with points, which the size of the shuffled windows does not show.
TASK_POINTS, MOST_TASKS = 1_000_000, 50_000


@dataclass(frozen=True)
class Geometry:
    """How rays are laid: how many, points and painted steps of each, and the radius in cells and metres."""

    n_radials: int
    points: int
    radius_px: float
    radius_m: float
    n_samples: int = 40

    def sample_points(self) -> list[int]:
        """The points (from 1) nearest to the scheduled distances."""
        return sorted({min(self.points, max(1, round(d / self.radius_m * self.points))) for d in sample_schedule(self.radius_m, self.n_samples)})

    def sample_distances(self) -> list[float]:
        return [k / self.points * self.radius_m for k in self.sample_points()]


def _dealt(near: DataFrame, sites: DataFrame, g: Geometry) -> DataFrame:
    """Windows dealt out by site, so that tasks have about TASK_POINTS points."""
    ship(sites.sparkSession)
    tasks = math.ceil(sites.count() * g.n_radials * g.points / TASK_POINTS)
    return near.repartition(max(1, min(MOST_TASKS, tasks)), "site")


def _window(group: pa.Table) -> tuple[np.ndarray, int, int]:
    """The cells of a site's blocks as one matrix (nan: none), and the row and column of its first."""
    br, bc = (np.array(group.column(c).to_pylist()) for c in ("br", "bc"))
    cells = np.array(group.column("cells").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(br), BLOCK + 1, BLOCK + 1)
    r0, c0 = br.min(), bc.min()
    out = np.full(((br.max() - r0 + 1) * BLOCK + 1, (bc.max() - c0 + 1) * BLOCK + 1), np.nan)
    for k in np.lexsort((bc, br)):
        r, c = (br[k] - r0) * BLOCK, (bc[k] - c0) * BLOCK
        part = out[r : r + BLOCK + 1, c : c + BLOCK + 1]
        np.copyto(part, cells[k], where=~np.isnan(cells[k]))
    return out, r0 * BLOCK, c0 * BLOCK


def _terrain(window, place: tuple[float, float, float], radials: np.ndarray, g: Geometry, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Elevations of the points of some rays (missing ones take the one before, else the site's), and how many points lie on the grid."""
    cells, top, left = window
    r, c, elev = place
    angle = np.radians(radials * 360.0 / g.n_radials)[:, None]
    part = np.arange(1, g.points + 1) / float(g.points)
    row = np.round(r + part * ((r - g.radius_px * np.cos(angle)) - r), 9)
    col = np.round(c + part * ((c + g.radius_px * np.sin(angle)) - c), 9)
    reach = np.logical_and.accumulate((row >= 0) & (row <= size[0] - 1) & (col >= 0) & (col <= size[1] - 1), axis=1).sum(axis=1)
    r0 = np.clip(np.floor(row), 0, max(size[0] - 2, 0)).astype(int)
    c0 = np.clip(np.floor(col), 0, max(size[1] - 2, 0)).astype(int)
    y, x = row - r0, col - c0
    at = lambda i, j: cells[np.clip(r0 + i - top, 0, len(cells) - 1), np.clip(c0 + j - left, 0, cells.shape[1] - 1)]
    found = (1 - y) * ((1 - x) * at(0, 0) + x * at(0, 1)) + y * ((1 - x) * at(1, 0) + x * at(1, 1))
    last = np.maximum.accumulate(np.where(np.isnan(found), -1, np.arange(g.points)), axis=1)
    return np.where(last < 0, elev, np.take_along_axis(found, np.maximum(last, 0), axis=1)), reach


def _clear(elev: np.ndarray, dist: np.ndarray, top: float, target_height: float) -> np.ndarray:
    """Whether each point's antenna sees the site's, by the running maximum of the slopes before it (see propagation.line_of_sight)."""
    bend = CURVATURE / (2 * EARTH_M)
    slope = (elev - top) / dist - dist * bend
    target = (elev + target_height - top) / dist - dist * bend
    out = np.ones(elev.shape, bool)
    out[:, 1:] = np.maximum.accumulate(slope, axis=1)[:, :-1] <= target[:, 1:]
    return out


def sightlines(sites: DataFrame, grid: Grid, g: Geometry) -> DataFrame:
    """site, view, radial, seen: for each ray and view whether the samples on the grid, from the nearest, are in sight.

    sites: site, r, c, site_elev, views (array of view, site_height, target_height). Rays shorter than SHORTEST_M or without a sample are left out.
    """
    size = grid.height, grid.width
    at = np.array(g.sample_points())
    dist = np.arange(1, g.points + 1) / float(g.points) * g.radius_m
    near = windows(sites.select("site", "r", "c", "site_elev", "views"), grid, math.ceil(g.radius_px))

    def cast(group: pa.Table) -> pa.Table:
        one = group.slice(0, 1).drop(["cells"]).to_pylist()[0]
        window = _window(group)
        views, radial, seen = [], [], []
        for first in range(0, g.n_radials, AT_ONCE):
            some = np.arange(first, min(first + AT_ONCE, g.n_radials))
            elev, reach = _terrain(window, (one["r"], one["c"], one["site_elev"]), some, g, size)
            count = np.searchsorted(at, reach, "right")
            use = np.flatnonzero((count > 0) & (dist[np.maximum(reach, 1) - 1] >= SHORTEST_M))
            for v in one["views"]:
                clear = _clear(elev[use], dist, one["site_elev"] + v["site_height"], v["target_height"])[:, at - 1]
                views += [v["view"]] * len(use)
                radial.append(some[use])
                seen.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count[use])]).astype(np.int32), pa.array(clear[np.arange(len(at)) < count[use][:, None]])))
        site = pa.array([one["site"]] * len(views), group.schema.field("site").type)
        return pa.table({"site": site, "view": pa.array(views, pa.int32()), "radial": pa.array(np.concatenate(radial), pa.int32()), "seen": pa.chunked_array(seen, pa.list_(pa.bool_()))})

    kind = sites.schema["site"].dataType.simpleString()
    return _dealt(near, sites, g).groupBy("site").applyInArrow(cast, f"site {kind}, view int, radial int, seen array<boolean>")


def profiles(sites: DataFrame, grid: Grid, g: Geometry) -> DataFrame:
    """site, radial, dist_m, elev_m (arrays): the terrain along each ray of sites (site, r, c, site_elev), as far as the grid goes."""
    size, dist = (grid.height, grid.width), np.arange(1, g.points + 1) / float(g.points) * g.radius_m
    near = windows(sites.select("site", "r", "c", "site_elev"), grid, math.ceil(g.radius_px))

    def lay(group: pa.Table) -> pa.Table:
        one = group.slice(0, 1).drop(["cells"]).to_pylist()[0]
        window, radial, high = _window(group), [], []
        for first in range(0, g.n_radials, AT_ONCE):
            some = np.arange(first, min(first + AT_ONCE, g.n_radials))
            elev, reach = _terrain(window, (one["r"], one["c"], one["site_elev"]), some, g, size)
            use = np.flatnonzero(dist[np.maximum(reach, 1) - 1] >= SHORTEST_M)
            use = use[reach[use] > 0]
            inside = np.arange(g.points) < reach[use][:, None]
            edges = np.concatenate([[0], np.cumsum(reach[use])]).astype(np.int32)
            radial.append(some[use])
            high.append(pa.ListArray.from_arrays(edges, pa.array(elev[use][inside])))
        n = sum(map(len, radial))
        site = pa.array([one["site"]] * n, group.schema.field("site").type)
        return pa.table({"site": site, "radial": pa.array(np.concatenate(radial), pa.int32()), "elev_m": pa.chunked_array(high)})

    kind = sites.schema["site"].dataType.simpleString()
    laid = _dealt(near, sites, g).groupBy("site").applyInArrow(lay, f"site {kind}, radial int, elev_m array<double>")
    known = F.transform("elev_m", lambda e, k: (k + 1) / F.lit(float(g.points)) * g.radius_m)
    return laid.select("site", "radial", known.alias("dist_m"), "elev_m")


def _loss_table(g: Geometry, model: str) -> tuple[list[float], float]:
    """The loss at each sample in sight, and what more it is out of sight, less what is the same for all samples: a margin is offset_db() less a loss."""
    if model == "los":
        return [-CLEAR_DB] * len(g.sample_points()), CLEAR_DB + BLOCKED_DB
    if model == "fspl_los":
        return [32.45 + 20 * math.log10(max(d, 1.0) / 1000) for d in g.sample_distances()], BLOCKED_EXTRA_DB
    raise ValueError(f"no such model: {model}")


def relative_losses(g: Geometry, model: str = "los") -> Column:
    """The losses at a ray's samples (column seen)."""
    clear, extra = _loss_table(g, model)
    known = F.array(*[F.lit(x) for x in clear])
    return F.transform("seen", lambda s, j: F.get(known, j) + F.when(s, 0.0).otherwise(extra))


def offset_db(budget: Column, freq_mhz: Column, model: str = "los") -> Column:
    return F.lit(0.0) if model == "los" else budget - 20 * F.log10(freq_mhz)


def _step_places(g: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evenly spaced steps: the sample before each, the share of the way to the next one, and how many cells out it lies. The same for all rays."""
    dist = np.array(g.sample_distances())
    x = np.arange(1, g.points + 1) * (g.radius_m / (g.points + 1))
    low = np.maximum(np.searchsorted(dist, x, "right") - 1, 0)
    after = np.minimum(low + 1, len(dist) - 1)
    share = np.where((x <= dist[low]) | (after == low), 0.0, (x - dist[low]) / np.where(after == low, 1.0, dist[after] - dist[low]))
    return low, share, x / g.radius_m * g.radius_px


def least_losses(one: dict, window, g: Geometry, model: str, size: tuple[int, int]) -> tuple[np.ndarray, int]:
    """The least relative loss over all rays in each cell around a site, a matrix for each of its views (inf: no ray), and how many cells from its edge the site lies."""
    at, (clear, extra), (low, share, out) = np.array(g.sample_points()), _loss_table(g, model), _step_places(g)
    clear, side = np.array(clear), math.ceil(g.radius_px) + 1
    dist = np.arange(1, g.points + 1) / float(g.points) * g.radius_m
    best = np.full((len(one["views"]), 2 * side + 1, 2 * side + 1), np.inf)
    for first in range(0, g.n_radials, AT_ONCE):
        some = np.arange(first, min(first + AT_ONCE, g.n_radials))
        elev, reach = _terrain(window, (one["r"], one["c"], one["site_elev"]), some, g, size)
        count = np.searchsorted(at, reach, "right")
        use = np.flatnonzero((count > 0) & (dist[np.maximum(reach, 1) - 1] >= SHORTEST_M))
        last = count[use][:, None] - 1
        here, after = np.minimum(low, last), np.minimum(low + 1, last)
        angle = np.radians(some[use] * 360.0 / g.n_radials)[:, None]
        even = lambda x: np.rint(np.rint(x * 1e9) / 1e9).astype(int)  # noqa: E731 (nine decimals first, so that halves are halves)
        row, col = even(one["r"] - out * np.cos(angle)), even(one["c"] + out * np.sin(angle))
        inside = (row >= 0) & (row < size[0]) & (col >= 0) & (col < size[1])
        cell = row[inside] - one["r"] + side, col[inside] - one["c"] + side
        for k, v in enumerate(one["views"]):
            seen = _clear(elev[use], dist, one["site_elev"] + v["site_height"], v["target_height"])[:, at - 1]
            loss = clear + np.where(seen, 0.0, extra)
            start = np.take_along_axis(loss, here, axis=1)
            steps = start + (np.take_along_axis(loss, after, axis=1) - start) * share
            np.minimum.at(best[k], cell, steps[inside])
    return best, side


def over_windows(sites: DataFrame, grid: Grid, g: Geometry, make, schema: str) -> DataFrame:
    """What make(site type, site with its views, window) returns for each site (site, r, c, site_elev, views) on the grid."""
    near = windows(sites.select("site", "r", "c", "site_elev", "views"), grid, math.ceil(g.radius_px))

    def each(group: pa.Table) -> pa.Table:
        return make(group.schema.field("site").type, group.slice(0, 1).drop(["cells"]).to_pylist()[0], _window(group))

    return _dealt(near, sites, g).groupBy("site").applyInArrow(each, f"site {sites.schema['site'].dataType.simpleString()}, {schema}")


def painted_losses(sites: DataFrame, grid: Grid, g: Geometry, model: str = "los") -> DataFrame:
    """site, view, r, c, loss: the least relative loss over all rays in each cell, linear between a ray's samples and constant beyond the outer ones."""
    size = grid.height, grid.width

    def paint(kind: pa.DataType, one: dict, window) -> pa.Table:
        best, side = least_losses(one, window, g, model, size)
        k, row, col = np.nonzero(best < np.inf)
        view = np.array([v["view"] for v in one["views"]])[k]
        return pa.table({"site": pa.array([one["site"]] * len(k), kind), "view": pa.array(view, pa.int32()), "r": pa.array(row + one["r"] - side, pa.int32()), "c": pa.array(col + one["c"] - side, pa.int32()), "loss": pa.array(best[k, row, col])})

    return over_windows(sites, grid, g, paint, "view int, r int, c int, loss double")


def ray_stats(rays: DataFrame, g: Geometry, offset: Column, floor_db: float, model: str = "los") -> DataFrame:
    """site, view, n_rays, n_covered, pct, first_ray_loss: rays whose best sample reaches the floor, and is over 0; and the relative loss at the first ray's end."""
    lost = rays.select("site", "view", "radial", F.inline(F.array(F.struct(relative_losses(g, model).alias("losses")))))
    best = offset - F.array_min("losses")
    stats = lost.groupBy("site", "view").agg(F.count_if(best >= floor_db).alias("n_rays"), F.count_if(best > 0).alias("n_covered"), F.min_by(F.element_at("losses", -1), "radial").alias("first_ray_loss"))
    return stats.withColumn("pct", F.col("n_covered") * 100.0 / g.n_radials)
