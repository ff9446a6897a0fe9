"""Queries of the composite entry points, sources and catalogues, with their SQL; a continuation of ``queries``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import crs, grid, names, soil_math
from .operators import geometry, ndvi, overlay, raster
from .plans import api
from .queries import _FIRST_SQL, _SOIL, _SOIL_PX, _TARGET, LL, PX, _first, _lonlat, _meta, _pixels, _r, _soil_layers, _t, query, soil_survey_tables
from .sources import catalog, features, files, tiff

_META = "raster_id string, source_ord int, a double, b double, c double, d double, e double, f double, height long, width long, crs string"


def _tiles(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Metadata of square-celled rasters from (raster_id, a, c, f, size, crs)."""
    return spark.createDataFrame([(i, k, float(a), 0.0, float(c), 0.0, float(-a), float(f), n, n, system) for k, (i, a, c, f, n, system) in enumerate(rows)], _META)


def _boxes_of(spark: SparkSession, sf: str) -> DataFrame:
    """A box for each customer, as a polygon."""
    return geometry.boxes_as_polygons(_lonlat(spark, sf).select(F.col("c_custkey").alias("geom_id"), F.col("lon").alias("minx"), F.col("lat").alias("miny"), (F.col("lon") + 0.7).alias("maxx"), (F.col("lat") + 0.3).alias("maxy")))


# --- Rasters: windows, bounds, resampling kernels, several rasters.


@query(f'WITH {_FIRST_SQL} SELECT r AS "row", c AS col, v AS value FROM f WHERE r BETWEEN 19 AND 30 AND c BETWEEN 9 AND 24')
def window_with_margin(spark, sf):
    return raster.within(_first(spark, sf), 20, 10, 10, 14, pad=1).select("row", "col", "value")


@query(f'WITH {_FIRST_SQL} SELECT r AS "row", c AS col, v AS value FROM f WHERE r BETWEEN 5 AND 40 AND c BETWEEN 30 AND 63')
def saved_window(spark, sf):
    path = files.scratch(spark, "pixels")
    files.save_pixels(_first(spark, sf), path)
    return files.load_window(spark, path, (5, 40), (30, 63)).select("row", "col", "value")


# Sources as rasters side by side and overlapping: source k starts at column and row 16 * (k - 1).
def _spread(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _pixels(spark, sf), _tiles(spark, *((str(k), 1.0, 16.0 * (k - 1), 64.0 - 16 * (k - 1), 64, "EPSG:32614") for k in range(1, 8))).withColumn("source_ord", F.col("raster_id").cast("int"))


_SPREAD = "w AS (SELECT source_ord, r + 16 * (source_ord - 1) AS r, c + 16 * (source_ord - 1) AS c, v FROM px)"


@query(f'WITH {PX}, {_SPREAD} SELECT r - 25 AS "row", c - 30 AS col, round(avg(v), 10) AS value FROM w WHERE r BETWEEN 25 AND 57 AND c BETWEEN 30 AND 80 GROUP BY 1, 2')
def merge_within_bounds(spark, sf):
    # Bounds within cells; an exact right edge takes one more column.
    pixels, meta = _spread(spark, sf)
    return raster.merged_within(pixels, meta, (30.25, 6.5, 80.0, 38.75), "mean")[0].select("row", "col", _r("value", 10).alias("value"))


@query("""WITH m AS (SELECT 0.5 * (1 + min(s_suppkey) % 3) AS a, min(s_suppkey) * 0.25 + 10 AS c, 64 - arg_min(s_nationkey, s_suppkey) * 0.125 AS f FROM supplier),
    k AS (SELECT *, floor((30.3 - c) / a) AS x0, floor((80.3 - c) / a) + 1 AS x1, floor((f - 38.7) / a) AS y0, floor((f - 6.6) / a) + 1 AS y1 FROM m)
    SELECT CAST(y1 - y0 AS DOUBLE) AS height, CAST(x1 - x0 AS DOUBLE) AS width, CAST(c + x0 * a AS DOUBLE) AS c, CAST(f - y0 * a AS DOUBLE) AS f FROM k""")
def merge_bounds_grid(spark, sf):
    # A raster for each supplier; the first one's grid decides.
    size = 0.5 * (1 + F.col("s_suppkey") % 3)
    meta = _t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("raster_id"), F.col("s_suppkey").alias("source_ord"), size.alias("a"), F.lit(0.0).alias("b"), (F.col("s_suppkey") * 0.25 + 10).alias("c"), F.lit(0.0).alias("d"), (-size).alias("e"), (64 - F.col("s_nationkey") * 0.125).alias("f"), F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit("EPSG:32614").alias("crs"))
    cells = meta.select("raster_id", "source_ord", F.lit(1).alias("band"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.lit(1.0).alias("value"))
    grid_of = raster.merged_within(cells, meta, (30.3, 6.6, 80.3, 38.7), allow_resampling=True)[1]
    return grid_of.select(F.col("height").cast("double").alias("height"), F.col("width").cast("double").alias("width"), "c", "f")


def _kernel(name: str, reach: int, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        # Weights of 256ths give means that end at place ten, so none is a tie there that depends on the order of the sum.
        return raster.reproject(_first(spark, sf), _meta(spark), _TARGET, name).filter("value is not null").select("row", "col", _r("value", 10).alias("value"))

    run.__name__ = f"reproject_{name}"
    weight = lambda t: "(" + re.sub(r"\bT\b", f"abs({t})", sql) + ")"
    query(f"""WITH {_FIRST_SQL}, g AS (SELECT i, j, (i + 0.5) * CAST(64.0 / 24 AS DOUBLE) AS y, (j + 0.5) * CAST(64.0 / 24 AS DOUBLE) AS x FROM range(24) AS a(i), range(24) AS b(j)),
        w AS (SELECT i, j, v, {weight('y - r - 0.5')} * {weight('x - c - 0.5')} AS w FROM g JOIN f ON r BETWEEN floor(y - 0.5) + {1 - reach} AND floor(y - 0.5) + {reach} AND c BETWEEN floor(x - 0.5) + {1 - reach} AND floor(x - 0.5) + {reach} WHERE v IS NOT NULL)
        SELECT i AS "row", j AS col, round(sum(w * v) / nullif(sum(w), 0), 10) AS value FROM w GROUP BY 1, 2 HAVING sum(w) <> 0""")(run)


_kernel("cubic", 2, "CASE WHEN T <= 1 THEN 1.5 * T * T * T - 2.5 * T * T + 1 WHEN T < 2 THEN -0.5 * T * T * T + 2.5 * T * T - 4 * T + 2 ELSE 0 END")
_kernel("cubic_spline", 2, "CASE WHEN T <= 1 THEN 2.0 / 3 - T * T + T * T * T / 2 WHEN T < 2 THEN (2 - T) * (2 - T) * (2 - T) / 6 ELSE 0 END")
_kernel("lanczos", 3, "CASE WHEN T = 0 THEN 1 WHEN T < 3 THEN 3 * sin(pi() * T) * sin(pi() * T / 3) / (pi() * T * pi() * T) ELSE 0 END")
_kernel("gauss", 2, "CASE WHEN T < 2 THEN pow(2.0, -T * T) ELSE 0 END")


def _lonlat_sql() -> str:
    """Longitude and latitude of (i, j, east, north) of a zone whose middle is 99 degrees west, a step a table."""
    n, radius, _, beta = crs._series(crs.WGS84[1])
    k = crs.UTM_SCALE * crs.WGS84[0] * radius
    term = lambda f, g: "".join(f" - {b!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, b in enumerate(beta, 1))
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return f"""p1 AS (SELECT i, j, north / {k!r} AS xi, (east - 500000) / {k!r} AS eta FROM g), p2 AS (SELECT i, j, xi{term('sin', 'cosh')} AS xp, eta{term('cos', 'sinh')} AS ep FROM p1),
        p3 AS (SELECT *, asin(sin(xp) / cosh(ep)) AS chi FROM p2), ll AS (SELECT i, j, -99 + degrees(atan2(sinh(ep), cos(xp))) AS lon, degrees(chi{"".join(f" + {d!r} * sin({2 * m} * chi)" for m, d in enumerate(delta, 1))}) AS lat FROM p3)"""


# A raster in hundredths of a degree on a grid of 1 km: every target centre is taken back to longitude and latitude.
@query(f"""WITH {_FIRST_SQL}, g AS (SELECT i, j, 455000 + (j + 0.5) * 1000 AS east, 4430000 - (i + 0.5) * 1000 AS north FROM range(75) AS a(i), range(60) AS b(j)), {_lonlat_sql()}
    SELECT i AS "row", j AS col, v AS value FROM ll JOIN f ON r = floor((40 - lat) / 0.01) AND c = floor((lon + 99.5) / 0.01)""")
def reproject_across_systems(spark, sf):
    meta = _tiles(spark, ("0", 0.01, -99.5, 40.0, 64, "EPSG:4326"))
    target = {"a": 1000.0, "c": 455000.0, "e": -1000.0, "f": 4430000.0, "height": 75, "width": 60, "crs": "EPSG:32614"}
    # Nodes at every cell, as the SQL has exact places.
    return raster.reproject(_first(spark, sf), meta, target, "nearest", tolerance=0).select("row", "col", "value")


@query(f'WITH {PX}, {_SPREAD} SELECT CAST(source_ord AS VARCHAR) AS raster_id, CAST(floor((r + 0.5) / 4) AS BIGINT) AS "row", CAST(floor((c + 0.5) / 4) AS BIGINT) AS col, round(avg(v), 10) AS value FROM w GROUP BY 1, 2, 3')
def reproject_each_raster(spark, sf):
    target = {"a": 4.0, "c": 0.0, "e": -4.0, "f": 64.0, "height": 40, "width": 40, "crs": "EPSG:32614"}
    return raster.reproject(*_spread(spark, sf), target, "average").select("raster_id", "row", "col", _r("value", 10).alias("value"))


# The other grid has cells of 4 whose borders lie one to the right and one above: the rasters' extent takes cells from -3 and 65 on.
_ON_FOUR = 'CAST(floor((r + 1.5) / 4) AS BIGINT) AS "row", CAST(floor((c + 3.5) / 4) AS BIGINT) AS col'


def _four(spark: SparkSession) -> DataFrame:
    return _tiles(spark, ("to", 4.0, 101.0, 165.0, 5, "EPSG:32614"))


@query(f"WITH {PX}, {_SPREAD} SELECT CAST(source_ord AS VARCHAR) AS raster_id, {_ON_FOUR}, max(v) AS value FROM w GROUP BY 1, 2, 3")
def align_rasters(spark, sf):
    return raster.align(*_spread(spark, sf), _four(spark), "max")[0].select("raster_id", "row", "col", "value")


@query(f'WITH {PX}, {_SPREAD}, e AS (SELECT source_ord, {_ON_FOUR}, avg(v) AS v FROM w GROUP BY 1, 2, 3) SELECT "row", col, round(avg(v), 10) AS value FROM e GROUP BY 1, 2')
def align_and_merge(spark, sf):
    return raster.align_and_merge(*_spread(spark, sf), _four(spark), "average", "mean")[0].select("row", "col", _r("value", 10).alias("value"))


@query(f'WITH {PX}, {_SPREAD}, e AS (SELECT source_ord, r, c, v FROM w) SELECT r AS "row", c AS col, arg_min(v, CAST(source_ord AS VARCHAR)) FILTER (WHERE v IS NOT NULL) AS value FROM e GROUP BY 1, 2')
def reproject_and_merge(spark, sf):
    # A system that the rasters have already: cells stay, and the common grid is that of the first one.
    return raster.reproject_and_merge(*_spread(spark, sf), "EPSG:32614", "nearest", "first")[0].select("row", "col", "value")


@query("SELECT p_partkey, round(c + o - CASE WHEN o > 5 THEN 10 ELSE 0 END, 6) AS origin FROM (SELECT p_partkey, p_size * 0.75 AS c, 1000.0 + p_partkey % 7 - p_size * 0.75 - 10 * floor((1000.0 + p_partkey % 7 - p_size * 0.75) / 10) AS o FROM part)")
def aligned_origins(spark, sf):
    own = F.col("p_size") * 0.75
    return _t(spark, sf, "part").select("p_partkey", _r(raster.aligned_origin(own, 1000.0 + F.col("p_partkey") % 7, F.lit(10.0))).alias("origin"))


@query("SELECT count(*) AS rasters FROM supplier")
def same_shape_of_all(spark, sf):
    m = _t(spark, sf, "supplier").select(F.lit(8).alias("height"), F.lit(9).alias("width"), F.lit(1.0).alias("a"), (F.col("s_suppkey") % 3 * 1e-6).alias("c"), F.lit(-1.0).alias("e"), F.lit(0.0).alias("f"))
    raster.same_shape(m, 1e-5)
    return m.agg(F.count("*").alias("rasters"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 1 THEN s_acctbal END AS value FROM supplier")
def nan_is_missing(spark, sf):
    v = F.when(F.col("s_suppkey") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    return raster.without_nan(_t(spark, sf, "supplier").select("s_suppkey", soil_math.valid(v).alias("value")))


@query(f"WITH {PX}, {_SPREAD}, p AS (SELECT s_suppkey, s_suppkey % 150 AS x, s_suppkey * 7 % 150 AS y FROM supplier) SELECT s_suppkey AS point_id, CAST(source_ord AS VARCHAR) AS raster_id, v AS value FROM p LEFT JOIN w ON c = x AND r = y")
def sample_many_rasters(spark, sf):
    places = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 150 + 0.5).alias("x"), (63.5 - F.col("s_suppkey") * 7 % 150).alias("y"))
    pixels, meta = _spread(spark, sf)
    # A raster holds a point where it has a cell for it; cells without a row are left out here, as in the SQL.
    out = raster.sample(places, pixels, meta)
    held = out.filter("band is not null")
    return held.select("point_id", "raster_id", "value").unionByName(places.select("point_id").join(held.select("point_id").distinct(), "point_id", "left_anti").select("point_id", F.lit(None).cast("string").alias("raster_id"), F.lit(None).cast("double").alias("value")))


# --- Depth layers and soil survey.


@query(f'WITH {_SOIL_PX.replace("least(45, bottom) - greatest(10, top)", "bottom - top").replace("10 < bottom AND 45 > top", "top >= 5 AND bottom <= 60")} SELECT r AS "row", c AS col, CASE WHEN count(*) = 3 THEN round(sum(w * m) / sum(w), 6) END AS mean, CASE WHEN count(*) = 3 THEN round(sqrt(sum(w * w * ((p5 - p95) / 3.29) * ((p5 - p95) / 3.29)) / sum(w * w)), 6) END AS stddev, CASE WHEN count(*) = 3 THEN round(sum(w * p95) / sum(w), 6) END AS p95 FROM d GROUP BY 1, 2')
def depth_statistics_of_whole_layers(spark, sf):
    out = api.depth_statistics(_soil_layers(spark, sf), "x", 5, 60, exact=True, extra=("p95",))
    return out.select("row", "col", _r("mean").alias("mean"), _r("stddev").alias("stddev"), _r("p95").alias("p95"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'B04' WHEN 1 THEN 'B08' ELSE 'SCL' END AS band FROM part")
def vegetation_bands(spark, sf):
    band = F.element_at(F.array(*map(F.lit, ("B04", "B08", "SCL"))), (F.col("p_size") % 3 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", names.ndvi_band(band).alias("band"))


_WEIGHTED = ", ".join(f"round(sum(w * {c}) / nullif(sum(CASE WHEN {c} IS NOT NULL THEN w END), 0), 5) AS {n}" for c, n in (("fine", "fine"), ("(100 - fine)", "gravel"), ("q", "om"), ("dens", "density"), ("vol", "volume")))


@query("WITH " + _SOIL + f""", hz AS (SELECT o_custkey AS cokey, least(80, 10.0 * l_linenumber + l_quantity) - greatest(20, 10.0 * (l_linenumber - 1)) AS w, (100 - l_tax * 100 - l_linenumber) * ((100 - l_quantity) / 100) AS fine, l_quantity AS q, l_discount AS dens, p_size AS vol, CASE WHEN p_size >= 10 THEN p_type END AS kind
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN prim ON prim.cokey = o_custkey JOIN part ON l_partkey = p_partkey WHERE 10.0 * l_linenumber + l_quantity > 20 AND 10.0 * (l_linenumber - 1) < 80),
    a AS (SELECT cokey, {_WEIGHTED}, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM hz GROUP BY 1)
    SELECT n_nationkey AS mukey, prim.cokey AS cokey, CASE WHEN prim.cokey % 3 = 0 THEN c_mktsegment END AS parent_material, fine, gravel, om, density, volume, kinds FROM nation LEFT JOIN prim ON mukey = n_nationkey LEFT JOIN customer ON c_custkey = prim.cokey LEFT JOIN a ON a.cokey = prim.cokey""")
def soil_survey(spark, sf):
    out = api.soil_components(soil_survey_tables(spark, sf), 20, 80)
    return out.select("mukey", "cokey", "parent_material", *(_r(c, 5).alias(n) for c, n in (("fine_fraction_percent_by_weight", "fine"), ("gravel_percent_by_weight", "gravel"), ("organic_matter_percent_of_fine_fraction_by_weight", "om"), ("oven_dry_bulk_density_g_per_cm3", "density"), ("fragment_percent_by_volume", "volume"))), F.col("fragment_kind").alias("kinds"))


# --- Geometry.

_EACH = f"{LL}, b AS (SELECT c_custkey, lon AS x0, lat AS y0, lon + 0.7 AS x1, lat + 0.3 AS y1 FROM ll)"


@query(f"WITH {_EACH}, k AS (SELECT c_custkey, greatest(x0, -110.0) AS x0, greatest(y0, 30.0) AS y0, least(x1, -80.25) AS x1, least(y1, 44.0) AS y1 FROM b) SELECT c_custkey, round((x1 - x0) * (y1 - y0), 6) AS area FROM k WHERE x1 > x0 AND y1 > y0")
def clip_to_rectangle(spark, sf):
    cut = geometry.clipped(_boxes_of(spark, sf), -110.0, 30.0, -80.25, 44.0).select(F.col("geom_id").alias("c_custkey"), geometry.area(F.col("rings")).alias("area"))
    return cut.filter("area > 0").select("c_custkey", _r("area").alias("area"))


# A right triangle for each nation, its legs of 3 along both axes; a box's share above the slanted side is taken off.
_TRI = "t AS (SELECT n_nationkey AS k, -125 + n_nationkey * 2.0 AS a, 26.0 + n_nationkey % 5 * 4 AS b FROM nation)"
_CORNER = "greatest(0, {u} + {v} - 3) * greatest(0, {u} + {v} - 3) / 2"


@query(f"""WITH {_EACH}, {_TRI}, k AS (SELECT c_custkey, k, greatest(x0 - a, 0) AS u0, greatest(y0 - b, 0) AS v0, least(x1 - a, 3) AS u1, least(y1 - b, 3) AS v1 FROM b, t),
    s AS (SELECT c_custkey, k, (u1 - u0) * (v1 - v0) - ({_CORNER.format(u='u1', v='v1')} - {_CORNER.format(u='u0', v='v1')} - {_CORNER.format(u='u1', v='v0')} + {_CORNER.format(u='u0', v='v0')}) AS area FROM k WHERE u1 > u0 AND v1 > v0)
    SELECT c_custkey, k AS area_id, round(area, 7) AS area FROM s WHERE area > 1e-9""")
def clip_to_polygons(spark, sf):
    a, b = -125 + F.col("n_nationkey") * 2.0, 26.0 + F.col("n_nationkey") % 5 * 4
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    tri = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("geom_id"), F.array(F.array(point(a, b), point(a + 3, b), point(a, b + 3), point(a, b))).alias("rings"))
    cut = overlay.clipped_to(_boxes_of(spark, sf), tri).select(F.col("geom_id").alias("c_custkey"), "area_id", "area")
    return cut.filter("area > 1e-9").select("c_custkey", "area_id", _r("area", 7).alias("area"))


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    """For each nation an L of two squares of 3 and 1.5 (keys 0 to 24) and a square of 3 with a square hole of 1 (keys 100 to 124)."""
    a, b = -125 + F.col("n_nationkey") * 2.0, 26.0 + F.col("n_nationkey") % 5 * 4
    ring = lambda *at: F.array(*(F.struct((a + x).alias("x"), (b + y).alias("y")) for x, y in (*at, at[0])))
    square = ring((0, 0), (3, 0), (3, 3), (0, 3))
    each = F.array(F.struct(F.col("n_nationkey").alias("geom_id"), F.array(ring((0, 0), (3, 0), (3, 1.5), (1.5, 1.5), (1.5, 3), (0, 3))).alias("rings")), F.struct((F.col("n_nationkey") + 100).alias("geom_id"), F.array(square, ring((1, 1), (2, 1), (2, 2), (1, 2))).alias("rings")))
    return _t(spark, sf, "nation").select(F.inline(each))


# A box's part in a shape is its part in the outer square less that in the square that the shape lacks.
_SHAPES = """s AS (SELECT n_nationkey AS k, -125 + n_nationkey * 2.0 AS a, 26.0 + n_nationkey % 5 * 4 AS b FROM nation),
    t AS (SELECT k, a, b, 1.5 AS u0, 3.0 AS u1 FROM s UNION ALL SELECT k + 100, a, b, 1.0, 2.0 FROM s),
    o AS (SELECT c_custkey, k, greatest(0, least(x1, a + 3) - greatest(x0, a)) * greatest(0, least(y1, b + 3) - greatest(y0, b)) AS outer_part, greatest(0, least(x1, a + u1) - greatest(x0, a + u0)) * greatest(0, least(y1, b + u1) - greatest(y0, b + u0)) AS lacking, (x1 - x0) * (y1 - y0) AS whole FROM b, t)"""


@query(f"WITH {_EACH}, {_SHAPES} SELECT c_custkey, CAST(k AS BIGINT) AS area_id, round(outer_part - lacking, 7) AS area FROM o WHERE outer_part - lacking > 1e-9")
def clip_to_concave(spark, sf):
    cut = overlay.clipped_to(_boxes_of(spark, sf), _shapes(spark, sf)).filter("area > 1e-9")
    return cut.select(F.col("geom_id").alias("c_custkey"), F.col("area_id").cast("long").alias("area_id"), _r("area", 7).alias("area"))


# The same shapes as areas to keep out of: shapes of one kind do not overlap within a row of nations five apart.
@query(f"WITH {_EACH}, {_SHAPES} SELECT c_custkey, round(any_value(whole) - sum(outer_part - lacking), 7) AS area FROM o WHERE k >= 100 GROUP BY 1 HAVING any_value(whole) - sum(outer_part - lacking) > 1e-9")
def outside_of_shapes(spark, sf):
    left = overlay.without(_boxes_of(spark, sf), _shapes(spark, sf).filter("geom_id >= 100")).filter("area > 1e-9")
    return left.select(F.col("geom_id").alias("c_custkey"), _r("area", 7).alias("area"))


# Boxes are whole hundredths, so a union's area and boundary can be counted in cells of a hundredth.
_UNION_CELLS = "u AS (SELECT DISTINCT c_nationkey AS k, x, y FROM (SELECT c_nationkey, x, unnest(range(j, j + 30)) AS y FROM (SELECT c_nationkey, (c_custkey * 53) % 2400 AS j, unnest(range((c_custkey * 37) % 5800, (c_custkey * 37) % 5800 + 70)) AS x FROM customer)))"


def _boxes_of_nations(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes_of(spark, sf).join(_lonlat(spark, sf).select(F.col("c_custkey").alias("geom_id"), "c_nationkey"), "geom_id")


@query(f"WITH {_UNION_CELLS} SELECT k AS c_nationkey, round(count(*) / 10000.0, 6) AS area FROM u GROUP BY 1")
def dissolved_area(spark, sf):
    found = overlay.union_pieces(_boxes_of_nations(spark, sf), "c_nationkey")
    return found.groupBy("c_nationkey").agg(_r(F.sum(overlay.piece_area())).alias("area"))


@query(f"WITH {_UNION_CELLS}, n AS (SELECT u.k, u.x, u.y, d.dx, d.dy FROM u, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy)) SELECT n.k AS c_nationkey, round(count(*) / 100.0, 6) AS length FROM n WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.k = n.k AND u.x = n.x + n.dx AND u.y = n.y + n.dy) GROUP BY 1")
def dissolved_boundary(spark, sf):
    found = overlay.union_pieces(_boxes_of_nations(spark, sf), "c_nationkey")
    long = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    return overlay.boundary(found, "c_nationkey").groupBy("c_nationkey").agg(_r(F.sum(long)).alias("length"))


@query(f"WITH {_EACH}, p AS (SELECT s_suppkey, -125 + ((s_suppkey * 131) % 5870) / 100.0 AS x, 25 + ((s_suppkey * 71) % 2430) / 100.0 AS y FROM supplier) SELECT DISTINCT s_suppkey, c_nationkey AS nation FROM p JOIN (SELECT b.*, c_nationkey FROM b JOIN customer USING (c_custkey)) ON x > x0 AND x < x1 AND y > y0 AND y < y1")
def inside_dissolved(spark, sf):
    # Boxes of one nation overlap; a point in two of them is inside their union.
    union = files.stored(overlay.dissolved(_boxes_of_nations(spark, sf), "c_nationkey").withColumnRenamed("c_nationkey", "geom_id"), "union")
    p = _t(spark, sf, "supplier").select("s_suppkey", (F.lit(-125) + (F.col("s_suppkey") * 131 % 5870) / 100.0).alias("x"), (F.lit(25) + (F.col("s_suppkey") * 71 % 2430) / 100.0).alias("y"))
    return geometry.points_in_polygons(p, union).select("s_suppkey", F.col("geom_id").alias("nation"))


@query(f"WITH {LL} SELECT c_custkey, part, round(lon + part, 4) AS minx, round(lat, 4) AS miny, round(lon + part + 0.5, 4) AS maxx, round(lat + 0.25, 4) AS maxy FROM ll, range(2) AS r(part)")
def wkt_part_bounds(spark, sf):
    ring = lambda x: f"((%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f))"  # noqa: E731, F541
    corners = [c for k in (0, 1) for c in (F.col("lon") + k, F.col("lat"), F.col("lon") + k + 0.5, F.col("lat"), F.col("lon") + k, F.col("lat") + 0.25, F.col("lon") + k, F.col("lat"))]
    text = F.format_string(f"MULTIPOLYGON ({ring(0)}, {ring(1)})", *corners)
    multi = _lonlat(spark, sf).select(F.col("c_custkey").alias("geom_id"), F.transform(geometry.wkt_rings(text), lambda r: F.array(r)).alias("parts"))
    return geometry.parts(multi).select(F.col("geom_id").alias("c_custkey"), F.col("part").cast("long").alias("part"), *(_r(v, 4).alias(k) for k, v in geometry.bounds(F.col("rings")).items()))


@query(f"WITH {_EACH}, {_TRI} SELECT c_custkey, k AS region_id FROM b, t WHERE x0 <= a + 3 AND x1 >= a AND y0 <= b + 3 AND y1 >= b AND greatest(x0, a) - a + greatest(y0, b) - b <= 3")
def polygons_meeting(spark, sf):
    a, b = -125 + F.col("n_nationkey") * 2.0, 26.0 + F.col("n_nationkey") % 5 * 4
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    tri = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("geom_id"), F.array(F.array(point(a, b), point(a + 3, b), point(a, b + 3), point(a, b))).alias("rings"))
    return geometry.polygons_meeting(_boxes_of(spark, sf), tri).select(F.col("left_id").alias("c_custkey"), F.col("right_id").alias("region_id"))


@query(f"WITH {_EACH}, g AS (SELECT n_nationkey AS region_id, -125.5 + n_nationkey * 2.5 AS a FROM nation) SELECT DISTINCT region_id FROM g JOIN b ON x0 <= a + 2.5 AND x1 >= a")
def regions_of_geometries(spark, sf):
    a = -125.5 + F.col("n_nationkey") * 2.5
    strips = geometry.boxes_as_polygons(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("geom_id"), a.alias("minx"), F.lit(20.0).alias("miny"), (a + 2.5).alias("maxx"), F.lit(60.0).alias("maxy")))
    return catalog.find_regions(_boxes_of(spark, sf), strips).select(F.col("geom_id").alias("region_id"))


@query("""SELECT c_custkey, concat('{"xmin":', c_custkey, '.5,"ymin":', c_nationkey, '.25,"xmax":', c_custkey + 1, '.5,"ymax":', c_nationkey + 1, '.25,"spatialReference":{"wkid":4326}}') AS box FROM customer""")
def esri_boxes(spark, sf):
    x, y = F.col("c_custkey") + 0.5, F.col("c_nationkey") + 0.25
    return _t(spark, sf, "customer").select("c_custkey", geometry.esri_envelope(x, y, x + 1, y + 1).alias("box"))


# --- Catalogues.

_ZONES = f"{LL}, s AS (SELECT c_custkey, floor(lon / 6) * 6 AS w, greatest(ceil((lon + 0.7) / 6) * 6, floor(lon / 6) * 6 + 6) AS e FROM ll)"


@query(f"WITH {_ZONES} SELECT c_custkey, CAST(unnest(range(CAST(floor((w + 181) / 6) AS BIGINT) + 1, CAST(floor((e + 179) / 6) AS BIGINT) + 2)) AS INTEGER) AS zone FROM s")
def utm_zones_of_geometries(spark, sf):
    return catalog.zones_of(_boxes_of(spark, sf)).select(F.col("geom_id").alias("c_custkey"), "zone")


_CELLS = f"{_EACH}, x AS (SELECT *, unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS x FROM b), g AS (SELECT DISTINCT x, unnest(range(CAST(floor(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT))) AS y FROM x)"


@query(f"WITH {_CELLS} SELECT printf('%s/%s/%d_%d/lat%d%d_lon%d%d.tif', p, s, t, b, y, y + 1, x, x + 1) AS path FROM g, (VALUES ('om'), ('bd')) AS q(p), (VALUES ('mean'), ('p5'), ('p95')) AS z(s), (VALUES (0, 5), (5, 15)) AS d(t, b)")
def soil_tile_plan(spark, sf):
    return catalog.soil_tiles(_boxes_of(spark, sf), ["om", "bd"], ["mean", "p5", "p95"], [(0, 5), (5, 15)]).select("path")


@query(f"WITH {_CELLS} SELECT DISTINCT concat(CASE WHEN y + 1 >= 0 THEN 'n' ELSE 's' END, lpad(CAST(abs(y + 1) AS VARCHAR), 2, '0'), CASE WHEN x <= 0 THEN 'w' ELSE 'e' END, lpad(CAST(abs(x) AS VARCHAR), 3, '0')) AS tile FROM g")
def elevation_tile_plan(spark, sf):
    return catalog.elevation_tiles(_boxes_of(spark, sf))


@query(f'WITH {PX} SELECT r AS "row", c AS col, arg_min(v, source_ord) FILTER (WHERE v IS NOT NULL) AS value FROM px WHERE source_ord BETWEEN 2 AND 4 GROUP BY 1, 2')
def soil_layer_of_tiles(spark, sf):
    # Source k is stored as the tile k degrees east of -102; the field touches the second to fourth.
    field = geometry.polygons(spark, [(1, [[(-99.5, 40.2), (-97.5, 40.2), (-97.5, 40.8), (-99.5, 40.8), (-99.5, 40.2)]])])
    path = grid.soil_tile_path(F.lit("om"), F.lit("mean"), F.lit(0), F.lit(5), F.col("source_ord") - 102, F.lit(40))
    return api.soil_layer(field, _pixels(spark, sf).withColumn("path", path), "om", "mean", 0, 5).select("row", "col", "value")


@query("SELECT lpad(CAST(n_nationkey * 100 AS VARCHAR), 4, '0') AS hu4, max_by(key, ord) AS key FROM nation JOIN (SELECT c_nationkey, concat('x/NHDPLUS_H_', lpad(CAST(c_nationkey * 100 AS VARCHAR), 4, '0'), '_HU4_2020', lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0'), '_RASTER.zip') AS key, c_custkey AS ord FROM customer) ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1")
def archives_of_regions(spark, sf):
    key = F.format_string("x/NHDPLUS_H_%04d_HU4_2020%04d_RASTER.zip", F.col("c_nationkey") * 100, F.col("c_custkey") % 1000)
    codes = _t(spark, sf, "nation").filter("n_regionkey = 1").select(F.format_string("%04d", F.col("n_nationkey") * 100).alias("hu4"))
    return catalog.archives_of(codes, _t(spark, sf, "customer").select(key.alias("key"), F.col("c_custkey").alias("ord")))


@query("SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 100.5 GROUP BY 1")
def parameterised_query(spark, sf):
    sql = "SELECT c_nationkey, count(*) AS n, cast(round(avg(c_acctbal), 4) AS string) AS mean FROM customer WHERE c_mktsegment IN (SELECT value FROM segments) AND c_acctbal > :least GROUP BY 1"
    return catalog.send_query(spark, sql, {"customer": _t(spark, sf, "customer")}, {"segments": ["BUILDING", "MACHINERY"]}, least=100.5)


# Tiles of 10 x 12 side by side, each with a number; orbits straight up at whole tens, two wide on both sides.
@query(f"""WITH {_EACH}, t AS (SELECT i, j, -130 + i * 10.0 AS a, 20 + j * 12.0 AS b FROM range(7) AS p(i), range(3) AS q(j)), o AS (SELECT k, -128 + k * 7.5 AS x FROM range(9) AS p(k)),
    h AS (SELECT i, j, greatest(x0, a) AS x0, least(x1, a + 10) AS x1 FROM b JOIN t ON x0 < a + 10 AND x1 > a AND y0 < b + 12 AND y1 > b)
    SELECT DISTINCT concat('t', i, j) AS tile_id, k AS orbit FROM h JOIN o ON x0 <= x + 2 AND x1 >= x - 2""")
def tiles_and_orbits(spark, sf):
    at = lambda i, j: (f"t{i}{j}", -130 + i * 10.0, 20 + j * 12.0, -120 + i * 10.0, 32 + j * 12.0)
    tiles = spark.createDataFrame([at(i, j) for i in range(7) for j in range(3)], "tile_id string, minx double, miny double, maxx double, maxy double")
    track = lambda k: [(-128 + k * 7.5, 0.0), (-128 + k * 7.5, 40.0), (-128 + k * 7.5, 80.0)]
    orbits = spark.createDataFrame([(k, track(k)) for k in range(9)], "orbit long, track array<struct<x:double,y:double>>")
    return catalog.tiles_and_orbits(_boxes_of(spark, sf), tiles, orbits, 2.0)


# Ten strips, of which some overlap; the SQL tries all sets of them, a set's first tile in its highest bit.
@query("""WITH t AS (SELECT n_nationkey AS k, 6 * (n_nationkey * 3 % 10) - 1.0 AS a, 6 * (n_nationkey * 3 % 10) + 7.0 + n_nationkey % 3 * 6 AS b FROM nation WHERE n_nationkey < 10),
    g AS (SELECT (c_custkey * 37 % 5600) / 100.0 AS x0, (c_custkey * 37 % 5600) / 100.0 + 0.7 AS x1 FROM customer), p AS (SELECT DISTINCT unnest([a, b]) AS x FROM t), c AS (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi FROM p),
    need AS (SELECT DISTINCT CAST((SELECT sum(1 << CAST(9 - k AS INTEGER)) FROM t WHERE a <= lo AND hi <= b) AS BIGINT) AS m FROM c WHERE EXISTS (SELECT 1 FROM g WHERE x0 < hi AND x1 > lo)),
    best AS (SELECT r.m FROM range(1, 1024) AS r(m) WHERE NOT EXISTS (SELECT 1 FROM need WHERE need.m & r.m = 0) ORDER BY bit_count(r.m), r.m DESC LIMIT 1)
    SELECT concat('t', k) AS tile FROM t, best WHERE (m >> CAST(9 - k AS INTEGER)) & 1 = 1""")
def min_tile_cover(spark, sf):
    x, a = F.col("c_custkey") * 37 % 5600 / 100.0, 6 * (F.col("n_nationkey") * 3 % 10) - 1.0
    spans = files.spread(_t(spark, sf, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("geom_id"), x.alias("minx"), F.lit(0.0).alias("miny"), (x + 0.7).alias("maxx"), F.lit(5.0).alias("maxy"))
    tiles = _t(spark, sf, "nation").filter("n_nationkey < 10").select(F.format_string("t%d", "n_nationkey").alias("tile_id"), a.alias("minx"), F.lit(0.0).alias("miny"), (a + 8 + F.col("n_nationkey") % 3 * 6).alias("maxx"), F.lit(5.0).alias("maxy"))
    return catalog.select_tiles(geometry.boxes_as_polygons(spans), tiles).select(F.col("tile_id").alias("tile"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-02-01' AND o_orderdate + INTERVAL 1 HOUR <= TIMESTAMP '1998-02-28'")
def scene_search_page(spark, sf):
    s = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 1 hour")).alias("end"))
    return names.month_scenes(s, 1998, 2, limit=1_000_000).select("o_orderkey")


# --- Files: what is written is read back through the readers.


@query("""SELECT concat('S/', p_partkey % 5, '.SAFE/G/T14TMM_20240901T172859_', b, '_', m, 'm.jp2') AS key FROM (SELECT DISTINCT p_partkey % 5 AS p_partkey, b, m FROM part, (VALUES ('B04', 10), ('B08', 10), ('SCL', 20)) AS v(b, m))
    UNION ALL SELECT DISTINCT concat('S/', p_partkey % 5, '.SAFE/Q/MSK_DETFOO_B04.jp2') FROM part""")
def manifest_keys(spark, sf):
    hrefs = [f"./G/T14TMM_20240901T172859_{b}_{m}m.jp2" for b in ("B04", "B08", "SCL", "B02") for m in (10, 20, 60)] + ["./Q/MSK_DETFOO_B04.jp2", "./Q/MSK_DETFOO_B02.jp2", "./x.xml"]
    xml = "<a>" + "".join(f"<fileLocation href='{h}'/>" for h in hrefs) + "<fileLocation/></a>"
    scenes = _t(spark, sf, "part").select(F.concat(F.lit("S/"), (F.col("p_partkey") % 5).cast("string"), F.lit(".SAFE")).alias("scene_key")).distinct()
    return names.wanted_keys(names.manifest_hrefs(scenes.withColumn("xml", F.lit(xml)))).select("key")


def _points_written(spark: SparkSession, sf: str) -> str:
    """Customers as points in order, a document and a folder for each nation, as a reader of whole files takes a file as one document."""
    path = files.scratch(spark, "geojson")
    feature = F.format_string('{"type":"Feature","properties":{"id":"%d"},"geometry":{"type":"Point","coordinates":[%.6f,%.6f]}}', "c_custkey", "lon", "lat")
    rows = _lonlat(spark, sf).select(F.col("c_nationkey").alias("k"), F.struct("c_custkey", feature.alias("f")).alias("f"))
    text = rows.groupBy("k").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("f"))["f"], ","), F.lit("]}")).alias("value"))
    text.write.partitionBy("k").text(path)
    return path


@query(f"WITH {LL} SELECT CAST(c_custkey AS VARCHAR) AS id, round(lon, 4) AS x, round(lat, 4) AS y FROM ll")
def geojson_points(spark, sf):
    got = files.geojson(spark, _points_written(spark, sf)).select(F.col("props")["id"].alias("id"), F.col("parts")[0][0][0].alias("p"))
    return got.select("id", _r("p.x", 4).alias("x"), _r("p.y", 4).alias("y"))


@query(f"""WITH {LL} SELECT CAST(c_custkey AS VARCHAR) AS id, c_nationkey, round(lon, 4) AS x, round(lat, 4) AS y,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS geom_id FROM ll""")
def geojson_split(spark, sf):
    # Ranges much shorter than a file, so that features lie across their borders.
    rows = features.split_geojson(spark, _points_written(spark, sf), 4096).select("path", "geom_id", F.col("props")["id"].alias("id"), F.col("parts")[0][0][0].alias("p"))
    nation = F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long")
    return rows.select("id", nation.alias("c_nationkey"), _r("p.x", 4).alias("x"), _r("p.y", 4).alias("y"), "geom_id")


@query(f"WITH {_EACH} SELECT c_custkey FROM b WHERE x0 <= -95 AND x1 >= -100 AND y0 <= 35 AND y1 >= 30")
def features_in_box(spark, sf):
    path = files.scratch(spark, "vectors")
    _lonlat(spark, sf).select("c_custkey", "c_nationkey", F.col("lon").alias("minx"), F.col("lat").alias("miny"), (F.col("lon") + 0.7).alias("maxx"), (F.col("lat") + 0.3).alias("maxy")).write.parquet(path)
    return files.features_in(spark.read.parquet(path), -100, 30, -95, 35, ["c_custkey"])


@query(f'WITH {PX} SELECT CAST(source_ord AS VARCHAR) AS raster_id, r AS "row", c AS col, v AS value FROM px WHERE v IS NOT NULL')
def tiff_round_trip(spark, sf):
    path = files.scratch(spark, "tiff")
    pixels, meta = _spread(spark, sf)
    tiff.write_tiffs(pixels, meta, path, tile=32)
    name = F.regexp_extract("raster_id", r"([^/]+)\.tif$", 1)
    return tiff.tiff_pixels(spark, path).filter("value is not null").select(name.alias("raster_id"), "row", "col", "value")


@query(f"""WITH {PX}, {_SPREAD} SELECT CAST(source_ord AS VARCHAR) AS raster_id, r - 16 * (source_ord - 1) AS "row", c - 16 * (source_ord - 1) AS col, v AS value FROM w
    WHERE v IS NOT NULL AND r BETWEEN 25 AND 57 AND c BETWEEN 30 AND 80""")
def tiff_window(spark, sf):
    path = files.scratch(spark, "tiff")
    pixels, meta = _spread(spark, sf)
    tiff.write_tiffs(pixels, meta, path, tile=16)
    name = F.regexp_extract("raster_id", r"([^/]+)\.tif$", 1)
    got = tiff.tiff_pixels(spark, path, bounds=(30.25, 6.5, 80.5, 38.75))
    return got.filter("value is not null").select(name.alias("raster_id"), "row", "col", "value")


# --- Points and areas through the facade.

_AT = "pt AS (SELECT s_suppkey, s_suppkey % 70 AS c, 63 - (s_suppkey * 7 % 70) AS r FROM supplier)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Points on a grid of cells of a thousandth of a degree whose upper left corner is (-100, 40)."""
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.lit(-100.0) + (F.col("s_suppkey") % 70 + 0.25) / 1000).alias("x"), (F.lit(40.0) - (63 - F.col("s_suppkey") * 7 % 70 + 0.75) / 1000).alias("y"))


def _degree_grid(spark: SparkSession, size: int = 64) -> DataFrame:
    return _tiles(spark, ("1", 0.001, -100.0, 40.0, size, "EPSG:4326"))


_LAST = f"{_FIRST_SQL}, l AS (SELECT r, c, arg_max(v, source_ord) FILTER (WHERE v IS NOT NULL) AS w FROM px GROUP BY 1, 2)"


@query(f"WITH {_LAST} SELECT s_suppkey AS point_id, v AS usgs_elevation, round(xm * ym, 6) AS polaris_carbon_stock_mean FROM (SELECT s_suppkey, s_suppkey % 70 AS c, 63 - (s_suppkey * 7 % 70) AS r FROM supplier) LEFT JOIN f USING (r, c) LEFT JOIN (SELECT r, c, 0.58 * pow(10, v) AS xm, w AS ym FROM f JOIN l USING (r, c)) USING (r, c)")
def point_facade(spark, sf):
    first, last = _first(spark, sf), raster.merge(_pixels(spark, sf), "last")
    layer = lambda df, prop: df.select(F.lit("1").alias("raster_id"), F.lit(prop).alias("property"), F.lit(0).alias("top"), F.lit(5).alias("bottom"), "row", "col", F.col("value").alias("mean"), F.col("value").alias("p5"), F.col("value").alias("p95"))
    sources = {"elevation_pixels": first.withColumn("raster_id", F.lit("1")), "elevation_meta": _degree_grid(spark), "soil_layers": layer(first, "om").unionByName(layer(last, "bd")), "soil_meta": _degree_grid(spark)}
    out = api.fetch_point_data(_points(spark, sf), ["usgs_topography", "polaris_carbon_stock"], sources, end_depth=5)
    return out.select("point_id", "usgs_elevation", _r("polaris_carbon_stock_mean").alias("polaris_carbon_stock_mean"))


@query(f"""WITH {_SOIL_PX}, {_AT}, o AS (SELECT r, c, CASE WHEN count(*) = 3 THEN 0.58 * sum(w * pow(10, m)) / sum(w) END AS xm, CASE WHEN count(*) = 3 THEN 0.58 * sqrt(sum(w * w * pow((pow(10, p5) - pow(10, p95)) / 3.29, 2)) / sum(w * w)) END AS xs,
        CASE WHEN count(*) = 3 THEN sum(w * (m + 1)) / sum(w) END AS ym, CASE WHEN count(*) = 3 THEN sqrt(sum(w * w * pow((p5 + 1 - p95) / 3.29, 2)) / sum(w * w)) END AS ys FROM d GROUP BY 1, 2)
    SELECT s_suppkey AS point_id, round(xm * ym, 6) AS mean, round(sqrt(xs * xs * ys * ys + xs * xs * ym * ym + ys * ys * xm * xm), 6) AS stddev FROM pt LEFT JOIN o USING (r, c)""")
def point_carbon(spark, sf):
    layers = _soil_layers(spark, sf, ("om", "bd")).withColumn("raster_id", F.lit("1"))
    up = lambda k: F.when(F.col("property") == "bd", F.col(k) + 1).otherwise(F.col(k))
    layers = layers.withColumns({"p5": up("p5"), "mean": up("mean")})
    out = api.fetch_point_data(_points(spark, sf), ["polaris_carbon_stock"], {"soil_layers": layers, "soil_meta": _degree_grid(spark, 32)}, start_depth=10, end_depth=45)
    return out.select("point_id", _r("polaris_carbon_stock_mean").alias("mean"), _r("polaris_carbon_stock_stddev").alias("stddev"))


# Scenes of April 1997 in two zones; points lie in the middle of cells, a block of 64 cells to a side for each zone.
_SCENES = "b AS (SELECT strftime(l_shipdate, '%Y%m%dT%H%M%S') AS dt, l_suppkey % 2 AS z, l_orderkey % 32 AS r, l_partkey % 32 AS c, floor(min(l_extendedprice) / 20) AS red, floor(max(l_quantity) * 100) AS nir, CAST(max(l_linenumber) + 2 AS INTEGER) AS scl FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-04-01' AND l_shipdate <= TIMESTAMP '1997-04-30' GROUP BY 1, 2, 3, 4)"


@query(f"""WITH {_SCENES}, i AS (SELECT z, r, c, CASE WHEN scl IN (3, 8, 9, 10) THEN NULL ELSE (nullif(nir, 0) - nullif(red, 0)) / nullif(nir + red, 0) END AS v FROM b), m AS (SELECT z, r, c, avg(v) AS mean, min(v) AS lo, max(v) AS hi, stddev_pop(v) AS sd FROM i GROUP BY 1, 2, 3)
    SELECT s_suppkey AS point_id, round(mean, 6) AS mean, round(lo, 6) AS min, round(hi, 6) AS max, round(sd, 6) AS stddev FROM supplier LEFT JOIN m ON z = s_suppkey % 2 AND r * 2 = s_suppkey * 7 % 70 AND c * 2 = s_suppkey % 70""")
def point_ndvi_zones(spark, sf):
    li = _t(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMMdd'T'HHmmss").alias("datatake"), (F.col("l_suppkey") % 2).alias("z"), (F.col("l_orderkey") % 32).alias("row"), (F.col("l_partkey") % 32).alias("col"))
    b = li.agg(F.floor(F.min("l_extendedprice") / 20).alias("B04"), F.floor(F.max("l_quantity") * 100).alias("B08"), (F.max("l_linenumber") + 2).alias("SCL"))
    zone = F.when(F.col("z") == 0, "EPSG:32614").otherwise("EPSG:32615")
    b = b.select(zone.alias("crs"), "datatake", F.lit(0).alias("source_ord"), "row", "col", F.explode(F.create_map(*(x for k in ("B04", "B08", "SCL") for x in (F.lit(k), F.col(k).cast("double"))))).alias("band", "value"))
    fine = lambda k: F.when(F.col("band") == "SCL", F.col(k)).otherwise(F.col(k) * 2)
    pixels = b.withColumns({"row": fine("row"), "col": fine("col")})
    meta = _tiles(spark, ("z14", 10.0, 500000.0, 4400000.0, 70, "EPSG:32614"), ("z15", 10.0, 500000.0, 4400000.0, 70, "EPSG:32615"))
    places = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("point_id"), F.when(F.col("s_suppkey") % 2 == 0, "EPSG:32614").otherwise("EPSG:32615").alias("zone"), (500000.0 + (F.col("s_suppkey") % 70 + 0.5) * 10).alias("x"), (4400000.0 - (F.col("s_suppkey") * 7 % 70 + 0.5) * 10).alias("y"))
    points = crs.moved_each(places, ["EPSG:32614", "EPSG:32615"], "zone", "EPSG:4326").select("point_id", "x", "y")
    out = api.fetch_point_data(points, ["sentinel2_ndvi"], {"scene_pixels": pixels, "scene_meta": meta}, year=1997, month=4)
    return out.select("point_id", *(_r(f"sentinel2_ndvi_{s}").alias(s) for s in ndvi.STATS))


@query("""WITH k AS (SELECT p_partkey % 64 AS r, (p_partkey // 64) % 64 AS c, max(p_size) AS v FROM part GROUP BY 1, 2), pt AS (SELECT s_suppkey, s_suppkey % 70 AS c, 63 - (s_suppkey * 7 % 70) AS r FROM supplier)
    SELECT s_suppkey AS point_id, 21001200000000 + v * 100 AS catchment_id, CAST(v * 3 AS BIGINT) AS flow_accumulation, CASE v % 10 WHEN 0 THEN 'SINK' WHEN 1 THEN 'E' WHEN 2 THEN 'SE' WHEN 4 THEN 'S' WHEN 8 THEN 'SW' END AS flow_direction FROM pt LEFT JOIN k USING (r, c)""")
def point_hydro(spark, sf):
    k = _t(spark, sf, "part").groupBy((F.col("p_partkey") % 64).alias("row"), (F.expr("p_partkey div 64") % 64).alias("col")).agg(F.max("p_size").cast("double").alias("v")).withColumn("raster_id", F.lit("1"))
    of = lambda v: k.select("raster_id", "row", "col", v.alias("value"))
    sources = {"cat_pixels": of(21001200000000 + F.col("v") * 100), "fac_pixels": of(F.col("v") * 3), "fdr_pixels": of(F.col("v") % 10), "hydro_meta": _degree_grid(spark)}
    out = api.fetch_point_data(_points(spark, sf), ["usgs_hydrography"], sources)
    return out.select("point_id", F.col("usgs_catchment_id").alias("catchment_id"), F.col("usgs_flow_accumulation").alias("flow_accumulation"), F.col("usgs_flow_direction").alias("flow_direction"))


@query(f"WITH {LL} SELECT c_custkey AS point_id, min(n_nationkey) AS ssurgo_unit, any_value(n_name ORDER BY n_nationkey) AS ssurgo_name FROM ll LEFT JOIN nation ON lon >= -125 + n_nationkey * 2.0 AND lon < -122.5 + n_nationkey * 2.0 AND lat > 25.5 AND lat <= 35.5 GROUP BY 1")
def point_soil(spark, sf):
    a = -125 + F.col("n_nationkey") * 2.0
    units = geometry.boxes_as_polygons(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("geom_id"), a.alias("minx"), F.lit(25.5).alias("miny"), (a + 2.5).alias("maxx"), F.lit(35.5).alias("maxy")))
    components = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("geom_id"), F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name"))
    points = _lonlat(spark, sf).select(F.col("c_custkey").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    out = api.fetch_point_data(points, ["ssurgo_primary_component"], {"soil_polygons": units, "soil_components": components}, end_depth=30)
    return out.select("point_id", "ssurgo_unit", "ssurgo_name")


# Elevation: sources side by side as degree tiles of four cells, those named after a tile that the area touches.
@query('WITH e AS (SELECT l_linenumber AS k, l_orderkey % 4 AS r, l_partkey % 4 AS c, max(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3), w AS (SELECT r, c + 4 * (k - 1) AS c, v FROM e) SELECT r AS "row", c AS col, v AS value FROM w WHERE r BETWEEN 1 AND 2 AND c BETWEEN 2 AND 9')
def elevation_mosaic(spark, sf):
    e = _t(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("source_ord"), (F.col("l_orderkey") % 4).alias("row"), (F.col("l_partkey") % 4).alias("col")).agg(F.max("l_discount").alias("value"))
    pixels = e.select(F.format_string("n41w%03d", 101 - F.col("source_ord")).alias("raster_id"), "source_ord", F.lit(1).alias("band"), "row", "col", "value")
    meta = _tiles(spark, *((f"n41w{100 - k:03d}", 0.25, -100.0 + k, 41.0, 4, "EPSG:4326") for k in range(7)))
    field = geometry.polygons(spark, [(1, [[(-99.45, 40.3), (-97.55, 40.3), (-97.55, 40.7), (-99.45, 40.7), (-99.45, 40.3)]])])
    return api.elevation(field, pixels, meta).filter("value is not null").select("row", "col", "value")


# Hydrography: two regions with the same local codes, which stand for other catchments in each.
_REG = "h AS (SELECT n_nationkey % 2 AS k, p_partkey % 16 AS r, (p_partkey // 16) % 16 AS c, max(p_size % 5) AS v FROM part JOIN nation ON p_partkey % 25 = n_nationkey GROUP BY 1, 2, 3)"


def _hydro(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    h = _t(spark, sf, "part").withColumn("k", F.col("p_partkey") % 25 % 2).groupBy("k", (F.col("p_partkey") % 16).alias("row"), (F.expr("p_partkey div 16") % 16).alias("col")).agg(F.max(F.col("p_size") % 5).cast("double").alias("value"))
    pixels = h.select(F.format_string("%04d", F.col("k") + 1).alias("hu4"), F.col("k").cast("string").alias("raster_id"), F.col("k").cast("int").alias("source_ord"), F.lit(1).alias("band"), "row", "col", "value")
    meta = _tiles(spark, ("0", 1.0, 0.0, 16.0, 16, "EPSG:5070"), ("1", 1.0, 16.0, 16.0, 16, "EPSG:5070")).withColumn("hu4", F.format_string("%04d", F.col("raster_id").cast("int") + 1))
    regions = geometry.polygons(spark, [(k + 1, [[(16.0 * k, 0.0), (16.0 * k + 16, 0.0), (16.0 * k + 16, 16.0), (16.0 * k, 16.0), (16.0 * k, 0.0)]]) for k in range(3)]).withColumn("hu4", F.format_string("%04d", "geom_id"))
    coded = _t(spark, sf, "part").select((F.col("p_partkey") % 25 % 2).alias("k"), (F.col("p_size") % 5).cast("int").alias("value"))
    side = coded.groupBy(F.format_string("%04d", F.col("k") + 1).alias("hu4"), "value", F.when(F.col("value") == 3, "none").otherwise((21001200000000 + F.col("k") * 1000 + F.col("value")).cast("string")).alias("id")).count()
    field = geometry.polygons(spark, [(1, [[(3.5, 2.5), (29.5, 2.5), (29.5, 9.5), (3.5, 9.5), (3.5, 2.5)]])])
    return api.hydrography(field, regions, pixels, meta, side)


@query(f"WITH {_REG} SELECT r AS \"row\", c + 16 * k AS col, CASE WHEN v <> 3 THEN 21001200000000 + k * 1000 + v END AS value FROM h WHERE r BETWEEN 6 AND 13 AND c + 16 * k BETWEEN 3 AND 29")
def hydrography_mosaic(spark, sf):
    return _hydro(spark, sf)[0].select("row", "col", F.col("value").cast("long").alias("value"))


@query("SELECT 21001200000000 + p_partkey % 25 % 2 * 1000 + p_size % 5 AS value, count(*) AS count FROM part WHERE p_size % 5 <> 3 GROUP BY 1")
def hydrography_counts(spark, sf):
    return _hydro(spark, sf)[1]


@query(f"WITH {_EACH}, u AS (SELECT n_nationkey AS mukey, -125 + n_nationkey * 2.0 AS a FROM nation), f AS (SELECT c_custkey, greatest(x0, a) AS x0, least(x1, a + 2.0) AS x1, mukey FROM b JOIN u ON x0 < a + 2.0 AND x1 > a) SELECT mukey, c_custkey AS area_id, round((x1 - x0) * 0.3, 6) AS area FROM f")
def soil_components_cropped(spark, sf):
    a = -125 + F.col("n_nationkey") * 2.0
    units = geometry.boxes_as_polygons(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("mukey"), a.alias("minx"), F.lit(20.0).alias("miny"), (a + 2.0).alias("maxx"), F.lit(60.0).alias("maxy")))
    out = api.soil_components_of(_boxes_of(spark, sf), units, soil_survey_tables(spark, sf), 0, 30)
    return out.filter("area > 1e-9").select("mukey", "area_id", _r("area").alias("area"))


# Fields with a corner cut out: each is two boxes beside one another.
@query(f"WITH {_EACH}, u AS (SELECT n_nationkey AS mukey, -125 + n_nationkey * 2.0 AS a FROM nation), f AS (SELECT c_custkey, mukey, greatest(0, least(x1, a + 2.0) - greatest(x0, a)) AS low, greatest(0, least(x0 + 0.35, a + 2.0) - greatest(x0, a)) AS high FROM b JOIN u ON x0 < a + 2.0 AND x1 > a) SELECT mukey, c_custkey AS area_id, round((low + high) * 0.15, 6) AS area FROM f WHERE low + high > 1e-9")
def soil_components_cropped_concave(spark, sf):
    a = -125 + F.col("n_nationkey") * 2.0
    units = geometry.boxes_as_polygons(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("mukey"), a.alias("minx"), F.lit(20.0).alias("miny"), (a + 2.0).alias("maxx"), F.lit(60.0).alias("maxy")))
    x, y = F.col("lon"), F.col("lat")
    ring = F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0, 0), (0.7, 0), (0.7, 0.15), (0.35, 0.15), (0.35, 0.3), (0, 0.3), (0, 0))))
    fields = _lonlat(spark, sf).select(F.col("c_custkey").alias("geom_id"), F.array(ring).alias("rings"))
    out = api.soil_components_of(fields, units, soil_survey_tables(spark, sf), 0, 30)
    return out.filter("area > 1e-9").select("mukey", "area_id", _r("area").alias("area"))


@query(f'WITH {_SOIL_PX.replace("least(45, bottom) - greatest(10, top)", "bottom - top").replace("10 < bottom AND 45 > top", "top >= 5 AND bottom <= 60")}, o AS (SELECT r, c, CASE WHEN count(*) = 3 THEN sum(w * m) / sum(w) END AS xm, CASE WHEN count(*) = 3 THEN sqrt(sum(w * w * pow((p5 - p95) / 3.29, 2)) / sum(w * w)) END AS xs, CASE WHEN count(*) = 3 THEN sum(w * (m + 1)) / sum(w) END AS ym, CASE WHEN count(*) = 3 THEN sqrt(sum(w * w * pow((p5 + 1 - p95) / 3.29, 2)) / sum(w * w)) END AS ys FROM d GROUP BY 1, 2) SELECT r AS "row", c AS col, round(xm * ym, 6) AS mean, round(sqrt(xs * xs * ys * ys + xs * xs * ym * ym + ys * ys * xm * xm), 6) AS stddev FROM o')
def carbon_stock_national(spark, sf):
    # The national grid has organic carbon itself, and its depths must be whole layers.
    up = lambda k: F.when(F.col("property") == "bd", F.col(k) + 1).otherwise(F.col(k))
    layers = _soil_layers(spark, sf, ("soc", "bd")).withColumns({"p5": up("p5"), "mean": up("mean")})
    return api.carbon_stock(layers, 5, 60, national=True).select("row", "col", _r("mean").alias("mean"), _r("stddev").alias("stddev"))
