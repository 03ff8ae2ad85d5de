"""Per-site margin cells to finished grids, coverage counts and map colours. Absent cells are empty."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

EMPTY = -1.0


def gap_fill_reach(radius_px: float, n_radials: int, factor: float) -> int:
    gap = 2 * math.pi * (radius_px / 2) / n_radials
    return max(2, round(gap * factor * 0.5))


def blur_radius(reach: int) -> int:
    return int(4 * max(1.0, 0.6 * reach) + 0.5)


def dense_cells(cells: DataFrame, margin: int, size: tuple[int, int] | None = None) -> DataFrame:
    """Every cell of each site's bounding box, padded and cut to the grid's size (height, width) if given; empty ones are 0."""
    box = cells.groupBy("site").agg((F.min("r") - margin).alias("r1"), (F.max("r") + margin).alias("r2"), (F.min("c") - margin).alias("c1"), (F.max("c") + margin).alias("c2"))
    if size:
        for k, last in (("r", size[0] - 1), ("c", size[1] - 1)):
            box = box.withColumns({f"{k}1": F.greatest(f"{k}1", F.lit(0)), f"{k}2": F.least(f"{k}2", F.lit(last))})
    grid = box.withColumn("r", F.explode(F.sequence("r1", "r2"))).withColumn("c", F.explode(F.sequence("c1", "c2"))).select("site", "r", "c")
    return grid.join(cells, ["site", "r", "c"], "left").withColumn("margin_db", F.coalesce("margin_db", F.lit(0.0)))


def gap_fill(cells: DataFrame, reach: int, margin: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Dense cells; an empty one takes the largest margin within reach (a square, as two passes of range frames)."""
    along_row = Window.partitionBy("site", "r").orderBy("c").rangeBetween(-reach, reach)
    along_col = Window.partitionBy("site", "c").orderBy("r").rangeBetween(-reach, reach)
    rows = dense_cells(cells, reach if margin is None else margin, size).withColumn("__m", F.max("margin_db").over(along_row)).withColumn("__m", F.max("__m").over(along_col))
    return rows.withColumn("margin_db", F.when(F.col("margin_db") == 0, F.col("__m")).otherwise(F.col("margin_db"))).drop("__m")


def _blur(rows: DataFrame, line: str, axis: str, weights: list[float]) -> DataFrame:
    """One separable pass: the cells of a line as an array, mirrored at both ends."""
    reach = len(weights) // 2
    lines = rows.groupBy("site", line).agg(F.array_sort(F.collect_list(F.struct(axis, "v", "__e"))).alias("a")).withColumn("n", F.size("a"))
    mirrored = lambda i: F.when(F.pmod(i, 2 * F.col("n")) < F.col("n"), F.pmod(i, 2 * F.col("n"))).otherwise(2 * F.col("n") - 1 - F.pmod(i, 2 * F.col("n"))).cast("int")
    total = lambda i: sum((F.lit(w) * F.get("a", mirrored(i + (k - reach)))["v"] for k, w in enumerate(weights)), F.lit(0.0))
    return lines.select("site", line, F.inline(F.transform("a", lambda x, i: F.struct(x[axis].alias(axis), total(i).alias("v"), x["__e"].alias("__e")))))


def _weights(reach: int) -> list[float]:
    sigma, radius = max(1.0, 0.6 * reach), blur_radius(reach)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smooth(cells: DataFrame, reach: int) -> DataFrame:
    """Gaussian smoothing of dense cells with empty ones at -1; cells that were empty are empty again afterwards."""
    weights = _weights(reach)
    start = cells.withColumn("v", F.when(F.col("margin_db") == 0, F.lit(EMPTY)).otherwise(F.col("margin_db")))
    done = _blur(_blur(start.select("site", "r", "c", "v", (F.col("v") == EMPTY).alias("__e")), "c", "r", weights), "r", "c", weights)
    return done.select("site", "r", "c", F.when(F.col("__e"), F.lit(EMPTY)).otherwise(F.col("v")).alias("margin_db"))


def threshold_clip(margin: Column, floor_db: float, max_db: float) -> Column:
    """-1 under the floor, else within [-1, max]."""
    return F.when(margin < floor_db, F.lit(EMPTY)).otherwise(F.least(F.greatest(margin, F.lit(EMPTY)), F.lit(float(max_db))))


def _box_max(grid: np.ndarray, reach: int) -> np.ndarray:
    """The largest value within reach of each cell, along rows and then along columns (the last two axes)."""
    for axis in (-2, -1):
        pad = [(reach, reach) if k == grid.ndim + axis else (0, 0) for k in range(grid.ndim)]
        grid = np.lib.stride_tricks.sliding_window_view(np.pad(grid, pad, constant_values=-np.inf), 2 * reach + 1, axis=axis).max(axis=-1)
    return grid


def _blur_grid(grid: np.ndarray, weights: list[float]) -> np.ndarray:
    """Weighted means along columns and then along rows (the last two axes), mirrored at the edges."""
    reach = len(weights) // 2
    for axis in (-2, -1):
        pad = [(reach, reach) if k == grid.ndim + axis else (0, 0) for k in range(grid.ndim)]
        wide = np.pad(grid, pad, mode="symmetric")
        n = grid.shape[axis]
        at = (lambda k: wide[..., k : k + n, :]) if axis == -2 else (lambda k: wide[..., k : k + n])
        grid = sum(w * at(k) for k, w in enumerate(weights))
    return grid


def finished(dense: np.ndarray, reach: int, floor_db, max_db) -> np.ndarray:
    """Dense grids (rows and columns are the last two axes, 0: empty) gap-filled, smoothed and thresholded; empty cells are EMPTY."""
    filled = np.where(dense == 0, _box_max(dense, reach), dense)
    empty = filled == 0
    done = _blur_grid(np.where(empty, EMPTY, filled), _weights(reach))
    return np.where(empty | (done < floor_db), EMPTY, np.clip(done, EMPTY, max_db))


def finish_grids(cells: DataFrame, keys: list[str], size: tuple[int, int] | None = None) -> DataFrame:
    """Gap-filled, smoothed, thresholded cells of each grid (keys, reach, floor_db, max_db, r, c, margin_db): keys, r, c, margin_db, without empty ones.

    A grid is laid out in one task: a site's window, bounded by its radius. With the size (height, width) of the whole grid the result is that of the whole
    grid: nothing is filled outside it and it is mirrored only at its own edges.
    """
    ship(cells.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def finish(grid: pa.Table) -> pa.Table:
        one = {c: grid.column(c)[0] for c in (*keys, "reach", "floor_db", "max_db")}
        reach = one["reach"].as_py()
        r, c, margin = (grid.column(x).to_numpy() for x in ("r", "c", "margin_db"))
        beyond = reach + (blur_radius(reach) if size else 0)
        low, high = [r.min() - beyond, c.min() - beyond], [r.max() + beyond, c.max() + beyond]
        if size:
            low, high = [max(x, 0) for x in low], [min(x, n - 1) for x, n in zip(high, size, strict=True)]
        dense = np.zeros((high[0] - low[0] + 1, high[1] - low[1] + 1))
        dense[r - low[0], c - low[1]] = margin
        done = finished(dense, reach, one["floor_db"].as_py(), one["max_db"].as_py())
        row, col = np.nonzero(done > EMPTY)
        columns = {k: pa.array([one[k].as_py()] * len(row), grid.schema.field(k).type) for k in keys}
        return pa.table({**columns, "r": pa.array(row + low[0], pa.int32()), "c": pa.array(col + low[1], pa.int32()), "margin_db": pa.array(done[row, col])})

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "r int, c int, margin_db double"])
    rows = cells.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("margin_db").cast("double").alias("margin_db"), "reach", "floor_db", "max_db")
    return rows.groupBy(*keys).applyInArrow(finish, schema)


def finish_grid(cells: DataFrame, reach: int, floor_db: float, max_db: float, size: tuple[int, int] | None = None) -> DataFrame:
    """finish_grids() of sites that share all parameters."""
    return finish_grids(cells.withColumns({"reach": F.lit(reach), "floor_db": F.lit(float(floor_db)), "max_db": F.lit(float(max_db))}), ["site"], size)


def coverage_count(cells: DataFrame) -> DataFrame:
    """r, c, n_sites: distinct sites with a positive margin."""
    return cells.filter("margin_db > 0").select("site", "r", "c").distinct().groupBy("r", "c").agg(F.count(F.lit(1)).alias("n_sites"))


def coverage_stats(counts: DataFrame, total_cells: int) -> DataFrame:
    return counts.agg(F.max("n_sites").alias("max_sites"), F.count(F.lit(1)).alias("covered_cells")).withColumn("pct", F.col("covered_cells") * 100.0 / total_cells)


def grid_stats(grids: DataFrame) -> DataFrame:
    """site, cells, best: how many cells each site's grid has, and its highest margin."""
    return grids.groupBy("site").agg(F.count(F.lit(1)).alias("cells"), F.max("margin_db").alias("best"))


def share_canonical(grids: DataFrame, members: DataFrame) -> DataFrame:
    """Every call's grid from its site's (members: callsign, site); with grid_stats() for grids what is told of them, once for all calls of a site."""
    return members.join(grids, "site")


def results_in_order(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Results (by callsign) in the order of the inputs (callsign, idx)."""
    return inputs.join(results, "callsign").orderBy("idx")


def run_summary(members: DataFrame, grids: DataFrame) -> DataFrame:
    """total, resolved, computed, shared, skipped calls of a run (members: callsign, canonical, site; grids: site, ...)."""
    done = members.join(grids.select("site", F.lit(True).alias("done")).distinct(), "site", "left")
    have, own = F.coalesce("done", F.lit(False)), F.col("callsign") == F.col("canonical")
    return done.agg(F.count(F.lit(1)).alias("total"), F.count_if(have).alias("resolved"), F.count_if(have & own).alias("computed"), F.count_if(have & ~own).alias("shared"), F.count_if(~have).alias("skipped"))


def margin_rgba(kind: Column, margin: Column, floor_db: float, max_db: float, alpha: float = 200.0) -> dict[str, Column]:
    """Colour columns of a station grid."""
    n = F.least(F.greatest((margin - floor_db) / (max_db - floor_db), F.lit(0.0)), F.lit(1.0))
    pick = lambda digi, gate: F.when(kind == "digi", digi).otherwise(gate)
    shown = F.when(margin > EMPTY, alpha * F.least(F.greatest(0.3 + 0.7 * n / 0.6, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return {"red": F.floor(pick(40 - 40 * n, 80 - 80 * n)).cast("int"), "green": F.floor(pick(120 + 135 * n, 160 - 130 * n)).cast("int"), "blue": F.floor(pick(40 - 40 * n, 200 + 55 * n)).cast("int"), "alpha": F.floor(shown).cast("int")}


def count_rgba(counts: DataFrame, hot: bool, alpha: int = 180) -> DataFrame:
    """Colour columns of a coverage count, relative to the largest."""
    most = counts.agg(F.max("n_sites")).first()[0] or 1
    n = F.col("n_sites") / F.lit(float(most))
    red, green, blue = (128 + 127 * n, 220 - 220 * n, F.lit(0.0)) if hot else (F.lit(0.0), 200 - 150 * n, 100 + 155 * n)
    return counts.withColumns({"red": F.floor(red).cast("int"), "green": F.floor(green).cast("int"), "blue": F.floor(blue).cast("int"), "alpha": F.when(F.col("n_sites") > 0.5, alpha).otherwise(0)})


def _count_columns(value: Column, most: Column, hot: bool, alpha: float) -> dict[str, Column]:
    n = value / most
    red, green, blue = (128 + 127 * n, 220 - 220 * n, F.lit(0.0)) if hot else (F.lit(0.0), 200 - 150 * n, 100 + 155 * n)
    return {"red": red, "green": green, "blue": blue, "alpha": F.when(value > 0.5, F.lit(float(alpha))).otherwise(0.0)}


#: A grid whose largest value is over this holds margins, any other one counts.
COUNTS_UP_TO = 1.5


def grid_rgba(cells: DataFrame, floor_db: float, max_db: float, hot: bool = True, alpha: float = 200.0) -> DataFrame:
    """Colour columns of whole grids (site, type, r, c, margin_db): margins where a station's grid holds any over COUNTS_UP_TO, else counts relative to the grid's largest.

    A grid without a type is no station's. Cells that are not shown have colour 0 throughout.
    """
    most = cells.groupBy(F.col("site").alias("__s")).agg(F.max("margin_db").alias("__most"))
    rows = cells.join(most, F.col("site").eqNullSafe(F.col("__s"))).drop("__s")
    margins = F.col("type").isNotNull() & (F.col("__most") > COUNTS_UP_TO)
    as_margin = margin_rgba(F.col("type"), F.col("margin_db"), floor_db, max_db, alpha)
    as_count = _count_columns(F.col("margin_db"), F.when(F.col("__most") > 0, F.col("__most")).otherwise(1.0), hot, alpha)
    shown = F.when(margins, F.col("margin_db") > EMPTY).otherwise(F.col("margin_db") > 0.5)
    pick = lambda c: F.when(shown, F.when(margins, as_margin[c]).otherwise(F.floor(as_count[c]))).otherwise(0).cast("int")
    return rows.withColumns({c: pick(c) for c in ("red", "green", "blue", "alpha")}).drop("__most")


def overlay_bounds(cells: DataFrame, north: float, west: float, step: float) -> DataFrame:
    """The box of each site's cells in degrees."""
    box = cells.groupBy("site").agg(F.min("r").alias("r1"), F.max("r").alias("r2"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    return box.select("site", (north - (F.col("r2") + 1) * step).alias("south"), (north - F.col("r1") * step).alias("north"), (west + F.col("c1") * step).alias("west"), (west + (F.col("c2") + 1) * step).alias("east"))
