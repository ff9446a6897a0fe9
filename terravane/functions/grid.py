"""Grids: affine transforms, bounds, snapping, alignment, integer tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative tolerance within which an offset counts as the next whole pixel.
CLOSE = 1e-9


def resolution(a: Column, e: Column) -> Column:
    """Pixel size in x and y."""
    return F.struct(a.alias("x"), (-e).alias("y"))


def floor_unless_close(n: Column) -> Column:
    """Floor, except just below a whole number, where it is that number."""
    up = F.ceil(n)
    return F.when(F.abs(n - up) <= CLOSE * F.greatest(F.abs(n), F.abs(up)), up).otherwise(F.floor(n)).cast("long")


def align_bounds(b: dict[str, Column], t: dict[str, Column]) -> dict[str, Column]:
    """Bounds (minx, miny, maxx, maxy) widened to whole pixels of the transform (a, c, e, f).

    The lower right pixel is the one that holds the corner, so an exact edge takes one more pixel.
    """
    col = floor_unless_close((b["minx"] - t["c"]) / t["a"])
    row = floor_unless_close((b["maxy"] - t["f"]) / t["e"])
    last_col = F.floor((b["maxx"] - t["c"]) / t["a"]) + 1
    last_row = F.floor((b["miny"] - t["f"]) / t["e"]) + 1
    return {
        "minx": t["c"] + col * t["a"],
        "maxy": t["f"] + row * t["e"],
        "maxx": t["c"] + last_col * t["a"],
        "miny": t["f"] + last_row * t["e"],
    }


def pixel_phase(origin: Column, bound: Column, size: Column) -> Column:
    """Offset of a bound on a grid in pixels, to two decimals, without its whole part."""
    return F.pmod(F.round((bound - origin) / size, 2), F.lit(1.0))


def grids_align(metas: DataFrame) -> DataFrame:
    """One row: do the grids (a, c, e, f, height, width) agree over their common extent?"""
    boxes = metas.select("a", "c", "e", "f", F.col("c").alias("minx"), F.col("f").alias("maxy"), (F.col("c") + F.col("a") * F.col("width")).alias("maxx"), (F.col("f") + F.col("e") * F.col("height")).alias("miny"))
    extent = boxes.agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), F.max("maxx").alias("x1"), F.max("maxy").alias("y1"))
    at = boxes.crossJoin(F.broadcast(extent))  # the extent is one row
    keys = F.struct(
        pixel_phase(F.col("c"), F.col("x0"), F.col("a")).alias("px"),
        pixel_phase(F.col("f"), F.col("y1"), F.col("e")).alias("py"),
        F.round((F.col("x1") - F.col("x0")) / F.col("a")).alias("w"),
        F.round((F.col("y0") - F.col("y1")) / F.col("e")).alias("h"),
    )
    return at.agg((F.count_distinct(keys) <= 1).alias("aligned"))


def snapped_tiles(boxes: DataFrame, base: int = 1) -> DataFrame:
    """Distinct whole-degree extents (minx, miny, maxx, maxy) of the parts of geometries.

    A part without extent on a grid line takes the cell above it.
    """
    lo = lambda c: (F.floor(F.col(c) / base) * base).cast("long")
    hi = lambda c, at: F.greatest(F.ceil(F.col(c) / base) * base, F.floor(F.col(at) / base) * base + base).cast("long")
    return boxes.select(lo("minx").alias("minx"), lo("miny").alias("miny"), hi("maxx", "minx").alias("maxx"), hi("maxy", "miny").alias("maxy")).distinct()


def grid_cells(tiles: DataFrame, base: int = 1) -> DataFrame:
    """Distinct (x, y) cells of extents."""
    some = tiles.filter("minx < maxx and miny < maxy")
    xs = some.select("miny", "maxy", F.explode(F.sequence("minx", F.col("maxx") - base, F.lit(base).cast("long"))).alias("x"))
    return xs.select("x", F.explode(F.sequence("miny", F.col("maxy") - base, F.lit(base).cast("long"))).alias("y")).distinct()


def soil_tile_path(prop: Column, stat: Column, top: Column, bottom: Column, x: Column, y: Column) -> Column:
    """Path of a soil-property tile."""
    return F.format_string("%s/%s/%d_%d/lat%d%d_lon%d%d.tif", prop, stat, top, bottom, y, y + 1, x, x + 1)


#: Product folder and version date of the national soil grids, and the one file with a name of its own (fixed values).
GRID_VERSIONS = {"BDW": "20230607", "SOC": "20220727", "CLY": "20210902", "PHW": "20220520"}
ODD_GRID = ("PHW", "EV", 0, 5, "20222005")


def national_grid_path(prop: Column, stat: Column, top: Column, bottom: Column) -> Column:
    """Path of a national soil grid."""
    version = F.coalesce(*(F.when(prop == k, v) for k, v in GRID_VERSIONS.items()))
    odd = (prop == ODD_GRID[0]) & (stat == ODD_GRID[1]) & (top == ODD_GRID[2]) & (bottom == ODD_GRID[3])
    return F.format_string("%s/%s_%03d_%03d_%s_N_P_AU_TRN_N_%s.tif", prop, prop, top, bottom, stat, F.when(odd, ODD_GRID[4]).otherwise(version))


def elevation_tile_name(north: Column, west: Column) -> Column:
    """Name of an elevation tile by its upper left corner."""
    ns = F.when(north >= 0, "n").otherwise("s")
    we = F.when(west <= 0, "w").otherwise("e")
    return F.format_string("%s%02d%s%03d", ns, F.abs(north), we, F.abs(west))
