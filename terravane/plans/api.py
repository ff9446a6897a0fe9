"""Composite entry points (E1-E8): data sources are DataFrames, points are joined by point_id.

Tables: ``pixels`` and ``meta`` as in ``operators.raster``; geometries as in ``operators.geometry``, in longitude and latitude; points:
point_id, x, y (longitude, latitude).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs, names, soil_math
from ..operators import geometry, ndvi, overlay, raster, soil
from ..sources import catalog
from ..sources.files import stored

#: Values that can be asked for, with the prefix of their columns (fixed values: names of the public data products).
VALUES = {"polaris_carbon_stock": "polaris_carbon_stock_", "sentinel2_ndvi": "sentinel2_ndvi_", "usgs_hydrography": "usgs_", "usgs_topography": "usgs_", "ssurgo_primary_component": "ssurgo_"}
HYDRO = {"catchment_id": "cat", "flow_accumulation": "fac", "flow_direction": "fdr"}


def depth_statistics(layers: DataFrame, prop: str, start: int, end: int, exact: bool = False, compat: bool = False, keys: tuple[str, ...] = ("row", "col"), extra: tuple[str, ...] = ()) -> DataFrame:
    """Depth-weighted mean and deviation of a property (E3, E4) from (property, top, bottom, *keys, mean, p5, p95, *extra).

    ``exact`` asks for whole layers.  Units are cleaned first; a cell without some layer is null.  ``extra`` statistics
    (p5, p95, p50, mode) are averaged like the mean.
    """
    wanted = soil_math.layers_between(start, end) if exact else soil_math.layers_including(start, end)
    rows = layers.filter((F.col("property") == prop) & F.struct("top", "bottom").isin([F.struct(F.lit(a), F.lit(b)) for a, b in wanted]))
    rows = rows.withColumns({k: soil_math.cleaned(prop, F.col(k)) for k in {"mean", "p5", "p95", *extra}})
    w = soil_math.layer_weight(start, end, F.col("top"), F.col("bottom"))
    whole = F.count(F.lit(1)) == len(wanted)
    return rows.groupBy(*keys).agg(
        F.when(whole, soil_math.weighted_mean(F.col("mean"), w)).alias("mean"),
        F.when(whole, soil_math.weighted_stddev(F.col("p5"), F.col("p95"), w, compat)).alias("stddev"),
        *(F.when(whole, soil_math.weighted_mean(F.col(k), w)).alias(k) for k in extra),
    )


def carbon_stock(layers: DataFrame, start: int, end: int, national: bool = False, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Carbon stock of each cell with its deviation (E2, E4, P13-P15): organic matter or carbon times bulk density."""
    share = 1.0 if national else soil_math.OM_TO_SOC
    of = lambda prop: depth_statistics(layers, prop, start, end, exact=national, keys=keys)
    om = of("soc" if national else "om").select(*keys, (F.col("mean") * share).alias("xm"), (F.col("stddev") * share).alias("xs"))
    bd = of("bd").select(*keys, F.col("mean").alias("ym"), F.col("stddev").alias("ys"))
    c = [F.col(k) for k in ("xm", "xs", "ym", "ys")]
    return om.join(bd, list(keys)).select(*keys, (c[0] * c[2]).alias("mean"), soil_math.product_stddev(*c).alias("stddev"))


def soil_layer(geometries: DataFrame, tiles: DataFrame, prop: str, statistic: str, top: int, bottom: int) -> DataFrame:
    """One statistic of one layer over the tiles that geometries touch, first valid value, units as stored.

    ``tiles``: the tile catalogue (path, source_ord, band, row, col, value), rows and columns on one grid.
    """
    wanted = catalog.soil_tiles(geometries, [prop], [statistic], [(top, bottom)])
    return raster.merge(catalog.tile_pixels(tiles, wanted))


def mosaic(pixels: DataFrame, meta: DataFrame, polygons: DataFrame | None = None, crop: bool = True, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Merged rasters, flagged where sources disagree, cut to polygons or to bounds.

    The grid is that of the first source, for merging and for cutting.
    """
    if bounds is not None:
        pixels, meta = raster.merged_within(pixels, meta, bounds)
        pixels = pixels.withColumns({"source_ord": F.lit(0), "raster_id": F.lit("merged")})
        out = pixels.drop("source_ord").withColumn("conflict", F.lit(None).cast("boolean"))
    else:
        meta = raster.source_order(pixels, meta)
        out = raster.merge_flagged(raster.rebased(pixels, meta)).withColumn("raster_id", F.lit("merged"))
        first = raster.base_grid(meta).select(*(F.col(f"{k}0").alias(k) for k in ("a", "c", "e", "f", "crs")))
        # Rows and columns count from the first source, so cells before it have negative ones.
        boxes = raster.extents(meta).agg(*(f(k).alias(k) for f, k in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))))
        row0, col0 = F.floor((F.col("maxy") - F.col("f")) / F.col("e") + 1e-6).cast("long"), F.floor((F.col("minx") - F.col("c")) / F.col("a") + 1e-6).cast("long")
        meta = first.crossJoin(boxes).select(F.lit("merged").alias("raster_id"), "a", "e", "crs", row0.alias("row0"), col0.alias("col0"), (F.col("c") + col0 * F.col("a")).alias("c"), (F.col("f") + row0 * F.col("e")).alias("f"), F.round((F.col("miny") - F.col("maxy")) / F.col("e")).cast("long").alias("height"), F.round((F.col("maxx") - F.col("minx")) / F.col("a")).cast("long").alias("width"))
    if polygons is None:
        return out.drop("raster_id")
    if "row0" not in meta.columns:
        return raster.mask(out, meta, polygons, all_touched=True, crop=crop).drop("raster_id")
    moved = meta.select("row0", "col0")
    out = out.crossJoin(F.broadcast(moved)).withColumns({"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")})  # one row
    out = raster.mask(out, meta, polygons, all_touched=True, crop=crop)
    return out.withColumns({"row": F.col("row") + F.col("row0"), "col": F.col("col") + F.col("col0")}).drop("row0", "col0", "raster_id")


def elevation(geometries: DataFrame, pixels: DataFrame, meta: DataFrame, crop: bool = True) -> DataFrame:
    """Elevation of the tiles that geometries touch, merged and cut to them (E5, S11, S12); tiles are named by raster_id."""
    wanted = catalog.elevation_tiles(geometries)
    near = meta.join(wanted, meta["raster_id"] == wanted["tile"], "left_semi")
    return mosaic(pixels.join(near.select("raster_id"), "raster_id", "left_semi"), near, geometries, crop)


def hydrography(geometries: DataFrame, regions: DataFrame, pixels: DataFrame, meta: DataFrame, side: DataFrame | None = None, crop: bool = True) -> tuple[DataFrame, DataFrame]:
    """One hydrography raster of the regions that geometries meet, merged and cut to them, and its counts.

    ``pixels`` and ``meta`` have the region in ``hu4``; meta and regions are in one reference system with the geometries.  ``side``:
    (hu4, value, id, count) for catchments, whose codes become ids of the whole country before regions are merged.
    """
    codes = stored(catalog.find_regions(geometries, regions).select("hu4"), "codes")
    near, cells = meta.join(codes, "hu4", "left_semi"), pixels.join(codes, "hu4", "left_semi")
    counts = pixels.sparkSession.createDataFrame([], "value long, count long")
    if side is not None:
        own = side.join(codes, "hu4", "left_semi").select("hu4", F.col("value").cast("double").alias("value"), F.expr("cast(try_cast(id as double) as long)").alias("id"), "count")
        cells = cells.join(own.filter("id is not null").select("hu4", "value", "id"), ["hu4", "value"], "left").withColumn("value", F.col("id").cast("double")).drop("id")
        # Whole archives count, not what is cut out; one without a side table leaves all counts out (Q10).
        lacking = codes.join(own, "hu4", "left_anti").isEmpty()
        if lacking:
            counts = raster.value_counts(own.filter("id is not null").select(F.col("id").alias("value"), "count"))
    return mosaic(cells.drop("hu4"), near.drop("hu4"), geometries, crop), counts


def vegetation(pixels: DataFrame, footprints: DataFrame | None = None, statistics: tuple[str, ...] = ndvi.STATS) -> DataFrame:
    """Monthly vegetation statistics by crs and cell from band pixels."""
    if footprints is not None:
        pixels = ndvi.footprint_masked(pixels, footprints)
    return ndvi.monthly(ndvi.datatake_index(pixels), statistics)


def vegetation_of(geometries: DataFrame, year: int, month: int, tiles: DataFrame, orbits: DataFrame, scenes: DataFrame, pixels: DataFrame, footprints: DataFrame | None = None, statistics: tuple[str, ...] = ndvi.STATS) -> DataFrame:
    """Monthly vegetation statistics over geometries (E7): tiles and orbits, scenes of the month, bands, index, statistics.

    ``scenes``: name, start, end; ``pixels`` as in ``operators.ndvi`` with tile_id.
    """
    where = catalog.tiles_for_geometries(geometries, tiles, orbits)
    found = names.month_scenes(scenes, year, month, limit=None).select(names.scene(F.col("name")).alias("s")).select("s.tile_id", "s.datatake", F.col("s.orbit").alias("orbit"))
    found = found.join(where, ["tile_id", "orbit"], "left_semi").select("tile_id", "datatake").distinct()
    return vegetation(pixels.join(found, ["tile_id", "datatake"], "left_semi"), footprints, statistics)


def projected(points: DataFrame, system: str) -> DataFrame:
    """(point_id, x, y) in a reference system, from longitude and latitude."""
    return crs.moved(points.select("point_id", "x", "y"), "EPSG:4326", system)


def placed(points: DataFrame, meta: DataFrame, own_zone: bool = False) -> DataFrame:
    """(point_id, raster_id, row, col) of the rasters that hold each point, whatever their systems; with ``own_zone`` only those of its UTM zone."""
    out = []
    points = stored(points.select("point_id", "x", "y"), "points")
    for code in sorted(r[0] for r in meta.select("crs").distinct().collect()):
        some = points.filter(F.concat(F.lit("EPSG:326"), F.lpad(crs.utm_zone(F.col("x")).cast("string"), 2, "0")) == code) if own_zone else points
        out.append(raster.cells_of(projected(some, code), meta.filter(F.col("crs") == code)))
    empty = points.select("point_id", F.lit("").alias("raster_id"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col")).limit(0)
    return functools.reduce(DataFrame.unionByName, out, empty)


def _first(at: DataFrame, value: str) -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col("raster_id"))).alias(value)


def point_raster(points: DataFrame, pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """(point_id, value) of the points that rasters hold; of several rasters the first valid value by raster_id."""
    at = placed(points, meta).join(pixels.select("raster_id", "row", "col", "value"), ["raster_id", "row", "col"])
    return at.groupBy("point_id").agg(_first(at, "value"))


def point_carbon(points: DataFrame, layers: DataFrame, meta: DataFrame, start: int, end: int) -> DataFrame:
    """(point_id, mean, stddev) of carbon stock: points are placed first, so only their cells are averaged."""
    at = placed(points, meta).join(layers, ["raster_id", "row", "col"])
    each = carbon_stock(at, start, end, keys=("point_id", "raster_id"))
    return each.groupBy("point_id").agg(_first(each, "mean"), _first(each, "stddev"))


def point_vegetation(points: DataFrame, pixels: DataFrame, meta: DataFrame, year: int, month: int, footprints: DataFrame | None = None) -> DataFrame:
    """(point_id, mean, min, max, stddev) of the month in each point's own zone (E1b); ``meta`` has a 10 m grid for each crs."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    seen = F.to_timestamp("datatake", "yyyyMMdd'T'HHmmss")
    pixels = pixels.filter((seen >= first.cast("timestamp")) & (seen <= F.last_day(first).cast("timestamp")))
    at = stored(placed(points, meta, own_zone=True).join(meta.select("raster_id", "crs"), "raster_id").drop("raster_id"), "placed")
    coarse = F.col("band") == "SCL"
    near = at.select("crs", F.expr("row div 2").alias("br"), F.expr("col div 2").alias("bc")).distinct()
    block = pixels.withColumns({"br": F.when(coarse, F.col("row")).otherwise(F.expr("row div 2")), "bc": F.when(coarse, F.col("col")).otherwise(F.expr("col div 2"))})
    index = vegetation(block.join(near, ["crs", "br", "bc"], "left_semi").drop("br", "bc"), footprints)
    return at.join(index, ["crs", "row", "col"]).drop("crs", "row", "col")


def point_hydrography(points: DataFrame, sources: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """(point_id, catchment_id, flow_accumulation, flow_direction) from the rasters cat, fac and fdr.

    With ``strict`` an unknown or missing flow direction raises (Q14).
    """
    out = points.select("point_id")
    for name, short in HYDRO.items():
        value = point_raster(points, sources[f"{short}_pixels"], sources["hydro_meta"])
        out = out.join(value.select("point_id", F.col("value").cast("long").alias(name)), "point_id", "left")
    return out.withColumn("flow_direction", soil_math.flow_direction(F.col("flow_direction"), strict))


def point_soil(points: DataFrame, polygons: DataFrame, components: DataFrame) -> DataFrame:
    """(point_id, columns of components) of the map unit that holds each point (E1e, Q18); of several the smallest geom_id."""
    at = geometry.points_in_polygons(points.select("point_id", "x", "y"), polygons).groupBy("point_id").agg(F.min("geom_id").alias("geom_id"))
    return at.join(components, "geom_id", "left").drop("geom_id")


def fetch_point_data(points: DataFrame, values: list[str], sources: dict[str, DataFrame], start_depth: int = 0, end_depth: int | None = None, year: int | None = None, month: int | None = None, strict: bool = False) -> DataFrame:
    """One row for each point with the values asked for (E1, E1a-E1e, J8, P30, P31).

    ``sources``: soil_layers and soil_meta (carbon); scene_pixels, scene_meta and, where there are some, footprints (vegetation);
    cat_pixels, fac_pixels, fdr_pixels and hydro_meta; elevation_pixels and elevation_meta; soil_polygons (geom_id, rings) and
    soil_components (geom_id, columns), or in its place soil_tables, whose components are averaged over the depths.
    """
    if not values or set(values) - set(VALUES):
        raise ValueError(f"values must be some of {tuple(VALUES)}")
    if {"polaris_carbon_stock", "ssurgo_primary_component"} & set(values) and end_depth is None:
        raise ValueError("an end depth is needed")
    if end_depth is not None and end_depth <= start_depth:
        raise ValueError("the end depth must be below the start depth")
    if "sentinel2_ndvi" in values and (year is None or month is None):
        raise ValueError("a year and a month are needed")
    if {"x", "y", "point_id"} - set(points.columns):
        raise ValueError("points need point_id, x and y")
    out = points
    for name in dict.fromkeys(values):
        if name == "polaris_carbon_stock":
            at = point_carbon(points, sources["soil_layers"], sources["soil_meta"], start_depth, end_depth)
        elif name == "sentinel2_ndvi":
            at = point_vegetation(points, sources["scene_pixels"], sources["scene_meta"], year, month, sources.get("footprints"))
        elif name == "usgs_hydrography":
            at = point_hydrography(points, sources, strict)
        elif name == "usgs_topography":
            at = point_raster(points, sources["elevation_pixels"], sources["elevation_meta"]).withColumnRenamed("value", "elevation")
        else:
            components = sources.get("soil_components")
            if components is None:
                components = soil_components(sources["soil_tables"], start_depth, end_depth).withColumnRenamed("mukey", "geom_id")
            at = point_soil(points, sources["soil_polygons"], components)
        kept = [c for c in at.columns if c != "point_id"]
        out = out.join(at.select("point_id", *(F.col(c).alias(VALUES[name] + c) for c in kept)), "point_id", "left")
    return out


def soil_components(tables: dict[str, DataFrame], top: float, bottom: float) -> DataFrame:
    """Primary soil components."""
    return soil.primary_soil_components(*(tables[k] for k in ("mapunit", "component", "copmgrp", "chorizon", "chfrags")), top, bottom)


def soil_components_of(geometries: DataFrame, units: DataFrame, tables: dict[str, DataFrame], top: float, bottom: float, crop: bool = True) -> DataFrame:
    """Primary soil components of the map units that geometries meet (E8, G10-G13): units (mukey, rings) are dissolved by key.

    With ``crop`` there is a row for each geometry and piece of a unit (parts and area of what they have in common), whatever their shapes;
    otherwise one for each unit, with the parts and area of its union.
    """
    pieces = units.withColumn("geom_id", F.monotonically_increasing_id())
    hit = geometry.polygons_meeting(pieces, geometries).select(F.col("left_id").alias("geom_id"))
    # Stored: a few rows that took all pairs to find, read several times.
    near = stored(pieces.join(hit.distinct(), "geom_id", "left_semi"), "units")
    own = tables | {"mapunit": tables["mapunit"].join(near.select("mukey"), "mukey", "left_semi")}
    out = soil_components(own, top, bottom)
    if not crop:
        return out.join(overlay.dissolved(near, "mukey"), "mukey")
    cut = overlay.clipped_to(near, geometries).join(near.select("geom_id", "mukey"), "geom_id").select("mukey", "area_id", "parts", "area")
    return out.join(cut, "mukey")
