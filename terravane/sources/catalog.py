"""Catalogues in the place of remote services: which tiles, archives, regions, scenes and orbits a query needs, and their rows.

A service that answers by key is a table with that key, and a query against it is a join that reaches its scan; a store of
objects is any folder that Spark's readers open (S6, S8, S10-S16, S20, S23-S25, G2, G4, G5, G7, G8, G15, J10, J16, O2).
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, grid, names
from ..operators import geometry, overlay
from . import files

_BOX = ["minx", "miny", "maxx", "maxy"]
#: Pieces of less than this area come from rounding.
LEAST_AREA = 1e-12


def part_boxes(geometries: DataFrame) -> DataFrame:
    """The extent of every part of the geometries."""
    parts = F.col("parts") if "parts" in geometries.columns else F.array("rings")
    return geometries.select(F.explode(parts).alias("rings")).select(*(v.alias(k) for k, v in geometry.bounds(F.col("rings")).items()))


def soil_tiles(geometries: DataFrame, props: list[str], statistics: list[str], layers: list[tuple[int, int]]) -> DataFrame:
    """(property, statistic, top, bottom, x, y, path) of every tile, layer and statistic that a query reads."""
    cells = grid.grid_cells(grid.snapped_tiles(part_boxes(geometries)))
    pick = lambda name, vs: F.explode(F.array(*map(F.lit, vs))).alias(name)
    depth = F.explode(F.array(*(F.struct(F.lit(a).alias("top"), F.lit(b).alias("bottom")) for a, b in layers))).alias("d")
    # A few properties, statistics and layers for each tile.
    all_of = cells.select("x", "y", pick("property", props)).select("*", pick("statistic", statistics)).select("*", depth).select("property", "statistic", "d.top", "d.bottom", "x", "y")
    return all_of.withColumn("path", grid.soil_tile_path(*(F.col(k) for k in ("property", "statistic", "top", "bottom", "x", "y"))))


def tile_pixels(tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pixels of the wanted paths from a table that is partitioned or sorted by path."""
    return tiles.join(wanted.select("path").distinct(), "path", "left_semi")


def elevation_tiles(geometries: DataFrame) -> DataFrame:
    """Distinct names of the elevation tiles that geometries touch."""
    cells = grid.grid_cells(grid.snapped_tiles(part_boxes(geometries)))
    return cells.select(grid.elevation_tile_name(F.col("y") + 1, F.col("x")).alias("tile")).distinct()


def find_regions(geometries: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions (geom_id, rings, ...) that geometries meet; raises where a geometry meets none."""
    # Read for the check, for the regions and by what follows.
    meets = files.stored(geometry.polygons_meeting(regions, geometries), "meets")
    lost = sorted(r[0] for r in geometries.select("geom_id").join(meets.select(F.col("right_id").alias("geom_id")), "geom_id", "left_anti").limit(20).collect())
    if lost:
        raise ValueError(f"geometries without a region: {lost}")
    return regions.join(meets.select(F.col("left_id").alias("geom_id")).distinct(), "geom_id", "left_semi")


def archives_of(codes: DataFrame, keys: DataFrame) -> DataFrame:
    """(hu4, key) of the newest archive of each region (S13-S16); an unknown code raises."""
    newest = names.newest_archives(keys)
    lost = sorted(r[0] for r in codes.select("hu4").distinct().join(newest, "hu4", "left_anti").limit(20).collect())
    if lost:
        raise ValueError(f"regions without an archive: {lost}")
    return newest.join(codes.select("hu4"), "hu4", "left_semi")


def object_path(root: str, key: str, prefix: str = "") -> str:
    """Where an object lies below a root; keys are normalised and must stay below the prefix."""
    clean = posixpath.normpath(key.lstrip("/"))
    if clean.startswith("..") or not clean.startswith(prefix.lstrip("/")):
        raise ValueError(f"unexpected key {key}")
    return f"{root.rstrip('/')}/{clean}"


def fetch_objects(spark: SparkSession, root: str, keys: list[str], prefix: str = "") -> DataFrame:
    """(key, content) of objects below a root of any file system that Spark opens (S10, S20); tasks read them, and the driver holds the keys only."""
    if not keys:
        return spark.createDataFrame([], "key string, content binary")
    paths = {object_path(root, k, prefix): k for k in keys}
    found = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    start = F.lit(len(root.rstrip("/").split("://")[-1].lstrip("/")) + 1)
    plain = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", ""), "^/+", "")
    return found.select(F.substr(plain, start + 1).alias("key"), "content")


def numeric_where_whole(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a number become numbers, the others stay text."""
    texts = [n for n, t in df.dtypes if t == "string"]
    if not texts:
        return df
    # One row: whether each column has values, and none that is not a number.
    whole = df.agg(*((F.count(F.expr(f"try_cast(`{c}` as double)")) == F.count(c)).alias(c) for c in texts)).first()
    return df.withColumns({c: F.col(c).cast("double") for c in texts if whole[c]})


def send_query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], lists: dict[str, list] | None = None, **params: object) -> DataFrame:
    """A parameterised query against local tables (S23, S24): ``:name`` takes a value, and a list is a table of its own with column ``value``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for name, values in (lists or {}).items():
        kind = "string" if any(isinstance(v, str) for v in values) else "double" if any(isinstance(v, float) for v in values) else "long"
        spark.createDataFrame([(v,) for v in values], f"value {kind}").createOrReplaceTempView(name)
    return numeric_where_whole(spark.sql(sql, args=params or None))


def keys_in_order(keys: DataFrame) -> DataFrame:
    """Scene keys by zone and datatake (O2)."""
    s = names.scene(F.element_at(F.split("scene_key", "/"), -1))
    return keys.orderBy(s["utm_zone"], s["datatake"], "scene_key")


def zones_of(geometries: DataFrame) -> DataFrame:
    """(geom_id, zone) of the UTM zones that geometries lie in (G2): extents on the 6 degree grid, a degree less on both sides."""
    west, east = F.floor(F.col("minx") / 6) * 6, F.greatest(F.ceil(F.col("maxx") / 6) * 6, F.floor(F.col("minx") / 6) * 6 + 6)
    zone = lambda x: (F.floor((x + 180) / 6) + 1).cast("int")
    parts = F.col("parts") if "parts" in geometries.columns else F.array("rings")
    boxes = geometries.select("geom_id", F.explode(parts).alias("rings")).select("geom_id", *(v.alias(k) for k, v in geometry.bounds(F.col("rings")).items()))
    return boxes.select("geom_id", F.explode(F.sequence(zone(west + 1), zone(east - 1))).alias("zone")).distinct()


def _projected(points: Column, zone: int) -> Column:
    def move(p: Column) -> Column:
        x, y = crs.to_utm(p["x"], p["y"], F.lit(zone))
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, move)


def select_tiles(geometries: DataFrame, tiles: DataFrame) -> DataFrame:
    """The fewest of ``tiles`` (tile_id, minx, miny, maxx, maxy) that cover the geometries (geom_id, rings or parts).

    Every tile that meets them is cut by the borders of the tiles that overlap it, and each piece counts for its first tile; the driver
    gets those tiles and the numbers of the pieces that hold a part of a geometry, and never a geometry.
    """
    boxes = tiles.select(F.col("tile_id").alias("geom_id"), *_BOX)
    areas = geometry.boxes_as_polygons(boxes)
    geometries = files.stored(geometries, "geometries")
    meets = geometry.polygons_meeting(areas, geometries).select(F.col("left_id").alias("geom_id")).distinct()
    near = [tuple(r) for r in boxes.join(meets, "geom_id", "left_semi").orderBy("geom_id").collect()]
    if not overlay.without(geometries, areas).filter(F.col("area") > LEAST_AREA).isEmpty():
        raise ValueError("the tiles do not cover the area")
    cells, holders = [], []
    for n, (_, x0, y0, x1, y1) in enumerate(near):
        beside = [(k, b) for k, (_, *b) in enumerate(near) if b[0] < x1 and b[2] > x0 and b[1] < y1 and b[3] > y0]
        xs, ys = (sorted({lo, hi, *(v for _, b in beside for v in (b[i], b[i + 2]) if lo < v < hi)}) for i, lo, hi in ((0, x0, x1), (1, y0, y1)))
        for a, b in zip(xs, xs[1:]):
            for c, d in zip(ys, ys[1:]):
                held = [k for k, t in beside if t[0] <= a and b <= t[2] and t[1] <= c and d <= t[3]]
                if held[0] == n:
                    cells.append((len(cells), float(a), float(c), float(b), float(d)))
                    holders.append(held)
    if not cells:
        return tiles.limit(0)
    lines = tiles.sparkSession.createDataFrame(cells, "geom_id long, minx double, miny double, maxx double, maxy double")
    pieces = overlay.clipped_to(geometries, geometry.boxes_as_polygons(lines)).filter(F.col("area") > LEAST_AREA)
    need = {r[0] for r in pieces.select("area_id").distinct().collect()}
    picked = geometry.minimal_cover_of([(t, {i for i in need if n in holders[i]}) for n, (t, *_) in enumerate(near)], need)
    return tiles.filter(F.col("tile_id").isin(picked))


def tiles_and_orbits(geometries: DataFrame, tiles: DataFrame, orbits: DataFrame, reach: float = geometry.SWATH_REACH) -> DataFrame:
    """(tile_id, orbit) in one plane (G5-G8, J10): the fewest tiles that cover the geometries, each with the orbits whose swath meets what lies in it.

    ``orbits``: orbit, track (array of points).
    """
    chosen = select_tiles(geometries, tiles)
    areas = geometry.boxes_as_polygons(chosen.select(F.col("tile_id").alias("geom_id"), *_BOX))
    pieces = overlay.clipped_to(geometries, areas).filter(F.col("area") > LEAST_AREA).select(F.col("area_id").alias("geom_id"), "parts")
    strips = orbits.select(F.col("orbit").alias("geom_id"), geometry.swath(F.col("track"), reach).alias("parts"))
    return geometry.polygons_meeting(pieces, strips).select(F.col("left_id").alias("tile_id"), F.col("right_id").alias("orbit")).distinct()


def tiles_for_geometries(geometries: DataFrame, tiles: DataFrame, orbits: DataFrame) -> DataFrame:
    """(tile_id, orbit) for geometries in longitude and latitude (G4): zone by zone, in the zone's own plane.

    ``tiles``: tile_id and rings, ``orbits``: orbit and track, all in longitude and latitude; a tile is named after its zone.
    """
    out = []
    zones = zones_of(geometries)
    # At most 60 numbers.
    for zone in sorted(r[0] for r in zones.select("zone").distinct().collect()):
        mine = geometries.join(zones.filter(F.col("zone") == zone).select("geom_id"), "geom_id", "left_semi")
        mine = geometry.clipped(mine, zone * 6.0 - 186, 0.0, zone * 6.0 - 180, 84.0).withColumn("rings", F.transform("rings", lambda r: _projected(r, zone)))
        own = tiles.filter(F.col("tile_id").startswith(f"{zone:02d}")).withColumn("rings", F.transform("rings", lambda r: _projected(r, zone)))
        # Written once, so that the projection is not part of every plan that follows.
        own = files.stored(own.select("tile_id", "rings"), "tiles")
        boxes = own.select("tile_id", *(v.alias(k) for k, v in geometry.bounds(F.col("rings")).items()))
        tracks = files.stored(orbits.withColumn("track", _projected(F.col("track"), zone)), "tracks")
        out.append(tiles_and_orbits(files.stored(mine, "geometries"), boxes, tracks))
    if not out:
        raise ValueError("no geometries")
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]
