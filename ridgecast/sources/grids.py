"""Elevation grids stored as blocks of cells, so that a plan reads the part of a grid that it needs.

A block holds 64 x 64 cells row by row and one more row and column, its neighbours' first: whatever lies between cells is found in
one block. Blocks are written once, partitioned by tile (a square of blocks); a one-row table beside them holds size and place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells along a block's side, and blocks along a tile's.
BLOCK, TILE = 64, 16
#: Tiles up to which the list of wanted ones is broadcast.
MOST_TILES = 1_000_000


@dataclass(frozen=True)
class Grid:
    """blocks: tile, br, bc, cells ((BLOCK + 1) ** 2 values, null where there is none). The origin is the outer corner of cell (0, 0), in metres of a UTM zone."""

    blocks: DataFrame
    height: int
    width: int
    easting0: float = 0.0
    northing0: float = 0.0
    cell_m: float = 1.0
    zone: int = 0
    south: bool = False

    @property
    def tiles(self) -> int:
        side = BLOCK * TILE
        return (self.height // side + 1) * (self.width // side + 1)


def tile_of(br: Column, bc: Column) -> Column:
    return (F.floor(br / TILE) * 65_536 + F.floor(bc / TILE)).cast("int")


def block_table(cells: DataFrame, value: str = "elev_m", by: tuple[str, ...] = (), nodata: float | None = None) -> DataFrame:
    """by, tile, br, bc, cells of cells (r, c, value); nodata is a value that means none."""
    side = BLOCK + 1
    own = lambda x: F.floor(F.col(x) / BLOCK).cast("int")
    blocks = lambda x: F.explode(F.when(F.pmod(F.col(x), F.lit(BLOCK)) == 0, F.array(own(x) - 1, own(x))).otherwise(F.array(own(x))))
    v = F.col(value).cast("double")
    v = v if nodata is None else F.when(v != nodata, v)
    rows = cells.select(*by, "r", "c", v.alias("v")).withColumn("br", blocks("r")).withColumn("bc", blocks("c"))
    place = ((F.col("r") - F.col("br") * BLOCK) * side + F.col("c") - F.col("bc") * BLOCK).cast("int")
    empty = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.struct(i.alias("i"), F.lit(None).cast("double").alias("v")))
    # Nulls sort first, so the last entry of a place is its cell's value.
    full = rows.groupBy(*by, "br", "bc").agg(F.sort_array(F.concat(F.collect_list(F.struct(place.alias("i"), "v")), empty)).alias("every"))
    last = F.filter("every", lambda x, k: F.coalesce(F.get("every", k + 1)["i"] != x["i"], F.lit(True)))
    return full.select(*by, tile_of(F.col("br"), F.col("bc")).alias("tile"), "br", "bc", F.transform(last, lambda x: x["v"]).alias("cells"))


def grid_of(cells: DataFrame, height: int, width: int, value: str = "elev_m", nodata: float | None = None, **place) -> Grid:
    """A grid from its cells; those outside it are left out."""
    inside = cells.filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    return Grid(block_table(inside, value, nodata=nodata).filter("br >= 0 and bc >= 0"), height, width, **place)


def write_grid(grid: Grid, path: str) -> Grid:
    """Write a grid's blocks and its size and place, and read it back."""
    spark = grid.blocks.sparkSession
    grid.blocks.write.mode("overwrite").partitionBy("tile").parquet(f"{path}/blocks")
    about = (grid.height, grid.width, float(grid.easting0), float(grid.northing0), float(grid.cell_m), grid.zone, grid.south)
    spark.createDataFrame([about], "height int, width int, easting0 double, northing0 double, cell_m double, zone int, south boolean").write.mode("overwrite").parquet(f"{path}/about")
    return read_grid(spark, path)


def read_grid(spark: SparkSession, path: str) -> Grid:
    about = spark.read.parquet(f"{path}/about").first().asDict()
    if about["height"] < 1 or about["width"] < 1:
        raise ValueError(f"the grid at {path} has no cells")
    return Grid(spark.read.schema("br int, bc int, cells array<double>, tile int").parquet(f"{path}/blocks").select("tile", "br", "bc", "cells"), **about)


def windows(sites: DataFrame, grid: Grid, reach: float) -> DataFrame:
    """sites (r, c, further columns) with each block that a square of `reach` cells around them touches: br, bc, cells.

    A semi-join with the tiles that any site wants comes first, so that only these are read from a stored grid.
    """
    last = lambda n: (n - 1) // BLOCK
    span = lambda x, n: F.sequence(F.greatest(F.floor((F.col(x) - reach - 1) / BLOCK), F.lit(0)).cast("int"), F.least(F.floor((F.col(x) + reach + 1) / BLOCK), F.lit(last(n))).cast("int"))
    near = sites.filter(F.col("r").between(0, grid.height - 1) & F.col("c").between(0, grid.width - 1))
    wanted = near.withColumn("__br", F.explode(span("r", grid.height))).withColumn("__bc", F.explode(span("c", grid.width)))
    wanted = wanted.withColumn("__tile", tile_of(F.col("__br"), F.col("__bc")))
    tiles = wanted.select(F.col("__tile").alias("tile")).distinct()
    blocks = grid.blocks.join(F.broadcast(tiles) if grid.tiles <= MOST_TILES else tiles, "tile", "left_semi")
    same = (F.col("__tile") == F.col("tile")) & (F.col("__br") == F.col("br")) & (F.col("__bc") == F.col("bc"))
    return wanted.join(blocks, same).drop("__tile", "__br", "__bc", "tile")
