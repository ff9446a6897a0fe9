"""The operators as queries over the driver's tables, each with the SQL that gives the same rows.

Rasters, soil tables and catalogues are derived from the tables in the same way on both sides; the derivations
stand first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import crs, grid, names, soil_math
from .operators import geometry, ndvi, raster, soil
from .plans import api
from .sources import files
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# Raster of seven overlapping sources on a 64 x 64 grid.
PX = "px AS (SELECT l_linenumber AS source_ord, l_orderkey % 64 AS r, l_partkey % 64 AS c, max(nullif(l_discount, 0)) AS v FROM lineitem GROUP BY 1, 2, 3)"


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("source_ord"), (F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col"))
    return p.agg(F.max(F.nullif(F.col("l_discount"), F.lit(0.0))).alias("value")).withColumns({"band": F.lit(1), "raster_id": F.col("source_ord").cast("string")})


def _first(spark: SparkSession, sf: str) -> DataFrame:
    return raster.merge(_pixels(spark, sf), "first")


_RULE_SQL = {
    "first": "arg_min(v, source_ord) FILTER (WHERE v IS NOT NULL)", "last": "arg_max(v, source_ord) FILTER (WHERE v IS NOT NULL)", "min": "min(v)", "max": "max(v)",
    "sum": "sum(v)", "count": "count(v)", "mean": "avg(v)", "variance": "var_pop(v)", "stddev": "stddev_pop(v)",
}


def _merge_query(rule: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        # Means of hundredths end or repeat before place ten, so no tie depends on the order of a sum.
        return raster.merge(_pixels(spark, sf), rule).select("row", "col", _r(F.col("value").cast("double"), 10).alias("value"))

    run.__name__ = f"merge_{rule}"
    query(f'WITH {PX} SELECT r AS "row", c AS col, round(CAST({_RULE_SQL[rule]} AS DOUBLE), 10) AS value FROM px GROUP BY 1, 2')(run)


for _rule in _RULE_SQL:
    _merge_query(_rule)


@query(f'WITH {PX} SELECT r AS "row", c AS col, arg_min(v, source_ord) FILTER (WHERE v IS NOT NULL) AS value, count(DISTINCT v) > 1 AS conflict FROM px GROUP BY 1, 2')
def merge_overlap_conflicts(spark, sf):
    return raster.merge_flagged(_pixels(spark, sf)).select("row", "col", "value", "conflict")


@query(f'WITH {PX}, m AS (SELECT r, c, arg_min(v, source_ord) FILTER (WHERE v IS NOT NULL) AS m FROM px GROUP BY 1, 2) SELECT r AS "row", c AS col, round(avg((v - m) * (v - m)), 8) AS value FROM px JOIN m USING (r, c) GROUP BY 1, 2')
def merge_variance_of_given_mean(spark, sf):
    return raster.merge_variance(_pixels(spark, sf), _first(spark, sf)).select("row", "col", _r("value", 8).alias("value"))


def _median(stack: np.ndarray) -> np.ndarray:
    """The middle of the valid values of each cell; missing ones sort last."""
    stack = np.sort(stack, axis=0)
    n, at = np.sum(~np.isnan(stack), axis=0), np.arange(stack.shape[1])
    return (stack[np.maximum(n - 1, 0) // 2, at] + stack[np.minimum(n // 2, len(stack) - 1), at]) / 2


def _smoothed(merged: np.ndarray, new: np.ndarray, merged_mask: np.ndarray, new_mask: np.ndarray) -> None:
    """Half of each later source and half of what the earlier ones gave."""
    both = ~merged_mask & ~new_mask
    np.copyto(merged, new, where=merged_mask)
    merged[both] = merged[both] * 0.5 + new[both] * 0.5


@query(f'WITH {PX} SELECT r AS "row", c AS col, round(median(v), 6) AS value FROM px GROUP BY 1, 2')
def merge_custom_median(spark, sf):
    return raster.merge(_pixels(spark, sf), _median).select("row", "col", _r("value").alias("value"))


@query(f'WITH {PX} SELECT r AS "row", c AS col, round(list_reduce(list(v ORDER BY source_ord) FILTER (WHERE v IS NOT NULL), lambda a, b: a * 0.5 + b * 0.5), 10) AS value FROM px GROUP BY 1, 2')
def merge_custom_fold(spark, sf):
    return raster.merge(_pixels(spark, sf), _smoothed).select("row", "col", _r("value", 10).alias("value"))


_BANDS_SQL = ", ".join(f"max(CASE WHEN source_ord = {k} THEN v END) AS b{k}" for k in range(1, 8))


@query(f'WITH {PX} SELECT r AS "row", c AS col, {_BANDS_SQL} FROM px GROUP BY 1, 2')
def stack_bands(spark, sf):
    return raster.stack(_pixels(spark, sf)).groupBy("row", "col").agg(*(F.max(F.when(F.col("band") == k + 1, F.col("value"))).alias(f"b{k}") for k in range(1, 8)))


def _meta(spark: SparkSession, crs_name: str = "EPSG:32614") -> DataFrame:
    return spark.createDataFrame([("0", 1.0, 0.0, 0.0, 0.0, -1.0, 64.0, 64, 64, crs_name)], "raster_id string, a double, b double, c double, d double, e double, f double, height long, width long, crs string")


# A convex polygon as half-planes: x + y >= 40, x <= 50.25, y <= 55.25 (y grows upwards, row 0 at the top).
def _triangle(spark: SparkSession) -> DataFrame:
    return geometry.polygons(spark, [(1, [[(-15.25, 55.25), (50.25, -10.25), (50.25, 55.25), (-15.25, 55.25)]])])


_FIRST_SQL = f"{PX}, f AS (SELECT r, c, arg_min(v, source_ord) FILTER (WHERE v IS NOT NULL) AS v FROM px GROUP BY 1, 2)"
_CENTRE = "c + 64.5 - 1 - r + 0.5 >= 40 AND c + 0.5 <= 50.25 AND 64 - r - 0.5 <= 55.25"
# A unit cell meets the polygon's inside: its upper right corner beyond the slanted side, and its lower left corner within the others.
_TOUCH = "c + 1 + 64 - r > 40 AND c < 50.25 AND 63 - r < 55.25"


def _one(spark: SparkSession, sf: str) -> DataFrame:
    return _first(spark, sf).withColumn("raster_id", F.lit("0"))


@query(f'WITH {_FIRST_SQL} SELECT r AS "row", c AS col, CASE WHEN {_CENTRE} THEN v END AS value FROM f')
def mask_centre(spark, sf):
    return raster.mask(_one(spark, sf), _meta(spark), _triangle(spark)).select("row", "col", "value")


@query(f'WITH {_FIRST_SQL} SELECT r AS "row", c AS col, CASE WHEN {_TOUCH} THEN v END AS value FROM f')
def mask_all_touched(spark, sf):
    return raster.mask(_one(spark, sf), _meta(spark), _triangle(spark), all_touched=True).select("row", "col", "value")


@query(f'WITH {_FIRST_SQL}, i AS (SELECT *, ({_CENTRE}) AS ok FROM f), b AS (SELECT min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM i WHERE ok) SELECT r AS "row", c AS col, CASE WHEN ok THEN v END AS value FROM i, b WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1')
def mask_crop(spark, sf):
    return raster.mask(_one(spark, sf), _meta(spark), _triangle(spark), crop=True).select("row", "col", "value")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 70 + 0.25).alias("x"), (F.col("s_suppkey") * 7 % 70 + 0.25).alias("y"))


@query(f"WITH {_FIRST_SQL} SELECT s_suppkey AS point_id, v AS value FROM supplier LEFT JOIN f ON r = 63 - (s_suppkey * 7 % 70) AND c = s_suppkey % 70")
def sample_points(spark, sf):
    return raster.sample(_places(spark, sf), _one(spark, sf), _meta(spark)).select("point_id", "value")


@query(f"WITH {PX} SELECT s_suppkey AS point_id, CAST(source_ord + 1 AS INTEGER) AS band, v AS value FROM supplier LEFT JOIN px ON r = 63 - (s_suppkey * 7 % 70) AND c = s_suppkey % 70")
def sample_points_multiband(spark, sf):
    return raster.sample(_places(spark, sf), raster.stack(_pixels(spark, sf)).withColumn("raster_id", F.lit("0")), _meta(spark)).select("point_id", "band", "value")


@query(f"WITH {_FIRST_SQL}, s AS (SELECT s_suppkey, 63 - (s_suppkey * 7 % 70) AS q, s_suppkey % 70 AS p FROM supplier) SELECT s_suppkey AS point_id, v AS value FROM s LEFT JOIN f ON r = CASE WHEN q < 0 THEN q + 64 ELSE q END AND c = p")
def sample_points_wrapped(spark, sf):
    return raster.sample(_places(spark, sf), _one(spark, sf), _meta(spark), wrap_negative=True).select("point_id", "value")


# Longitude and latitude of a customer.
LL = "ll AS (SELECT c_custkey, c_nationkey, -125 + ((c_custkey * 37) % 5800) / 100.0 + 0.005 AS lon, 25 + ((c_custkey * 53) % 2400) / 100.0 + 0.005 AS lat FROM customer)"


def _lonlat(spark: SparkSession, sf: str) -> DataFrame:
    return files.spread(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("c_custkey", "c_nationkey", (F.lit(-125) + (F.col("c_custkey") * 37 % 5800) / 100.0 + 0.005).alias("lon"), (F.lit(25) + (F.col("c_custkey") * 53 % 2400) / 100.0 + 0.005).alias("lat"))


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    p = _lonlat(spark, sf)
    return p.select(F.col("lon").alias("minx"), F.col("lat").alias("miny"), (F.col("lon") + 0.7).alias("maxx"), (F.col("lat") + 0.3).alias("maxy"))


_SNAP = f"WITH {LL}, s AS (SELECT DISTINCT CAST(floor(lon) AS BIGINT) AS minx, CAST(floor(lat) AS BIGINT) AS miny, CAST(ceil(lon + 0.7) AS BIGINT) AS maxx, CAST(ceil(lat + 0.3) AS BIGINT) AS maxy FROM ll)"
_CELLS = _SNAP + ", x AS (SELECT *, unnest(range(minx, maxx)) AS x FROM s), g AS (SELECT DISTINCT x, unnest(range(miny, maxy)) AS y FROM x)"


@query(f"{_SNAP} SELECT * FROM s")
def bounds_snapped_tiles(spark, sf):
    return grid.snapped_tiles(_boxes(spark, sf))


@query(f"{_CELLS} SELECT x, y FROM g")
def grid_cell_enumeration(spark, sf):
    return grid.grid_cells(grid.snapped_tiles(_boxes(spark, sf)))


@query(f"""{_CELLS} SELECT x, y, printf('om/mean/0_5/lat%d%d_lon%d%d.tif', y, y + 1, x, x + 1) AS soil_tile,
    concat(CASE WHEN y + 1 >= 0 THEN 'n' ELSE 's' END, lpad(CAST(abs(y + 1) AS VARCHAR), 2, '0'), CASE WHEN x <= 0 THEN 'w' ELSE 'e' END, lpad(CAST(abs(x) AS VARCHAR), 3, '0')) AS elevation_tile FROM g""")
def tile_names(spark, sf):
    g = grid.grid_cells(grid.snapped_tiles(_boxes(spark, sf)))
    return g.select("x", "y", grid.soil_tile_path(F.lit("om"), F.lit("mean"), F.lit(0), F.lit(5), F.col("x"), F.col("y")).alias("soil_tile"), grid.elevation_tile_name(F.col("y") + 1, F.col("x")).alias("elevation_tile"))


@query("""SELECT p_partkey, concat(p, '/', p, '_', lpad(CAST(t AS VARCHAR), 3, '0'), '_', lpad(CAST(b AS VARCHAR), 3, '0'), '_', s, '_N_P_AU_TRN_N_', CASE WHEN p = 'PHW' AND s = 'EV' AND t = 0 THEN '20222005' ELSE v END, '.tif') AS path FROM (
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'BDW' WHEN 1 THEN 'SOC' WHEN 2 THEN 'CLY' ELSE 'PHW' END AS p, CASE p_partkey % 4 WHEN 0 THEN '20230607' WHEN 1 THEN '20220727' WHEN 2 THEN '20210902' ELSE '20220520' END AS v,
    CASE p_size % 3 WHEN 0 THEN 'EV' WHEN 1 THEN '05' ELSE '95' END AS s, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 5 END AS t, CASE WHEN p_size % 2 = 0 THEN 5 ELSE 15 END AS b FROM part)""")
def national_grid_paths(spark, sf):
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    even = F.col("p_size") % 2 == 0
    return _t(spark, sf, "part").select("p_partkey", grid.national_grid_path(
        pick(F.col("p_partkey") % 4, "BDW", "SOC", "CLY", "PHW"), pick(F.col("p_size") % 3, "EV", "05", "95"), F.when(even, 0).otherwise(5), F.when(even, 5).otherwise(15)).alias("path"))


@query("""SELECT p_partkey, round(c + k0 * 10.0, 6) AS minx, round(f - k1 * 10.0, 6) AS maxy, round(c + (floor((x1 - c) / 10.0) + 1) * 10.0, 6) AS maxx, round(f - (floor((f - y0) / 10.0) + 1) * 10.0, 6) AS miny FROM (
    SELECT *, CASE WHEN abs(n0 - ceil(n0)) <= 1e-9 * greatest(abs(n0), abs(ceil(n0))) THEN ceil(n0) ELSE floor(n0) END AS k0, CASE WHEN abs(n1 - ceil(n1)) <= 1e-9 * greatest(abs(n1), abs(ceil(n1))) THEN ceil(n1) ELSE floor(n1) END AS k1 FROM (
    SELECT *, (x0 - c) / 10.0 AS n0, (y1 - f) / -10.0 AS n1 FROM (
    SELECT p_partkey, p_size * 0.5 AS c, 500.0 + p_size * 0.25 AS f, 100.0 + p_partkey % 97 AS x0, 100.0 + p_partkey % 97 + p_size * 3 AS x1, 200.0 - p_partkey % 89 AS y0, 200.0 - p_partkey % 89 + p_size * 2 AS y1 FROM part)))""")
def align_bounds(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    b = {"minx": 100.0 + k % 97, "maxx": 100.0 + k % 97 + s * 3, "miny": 200.0 - k % 89, "maxy": 200.0 - k % 89 + s * 2}
    out = grid.align_bounds(b, {"a": F.lit(10.0), "c": s * 0.5, "e": F.lit(-10.0), "f": 500.0 + s * 0.25})
    return _t(spark, sf, "part").select("p_partkey", *(_r(v).alias(n) for n, v in out.items()))


@query("""WITH m AS (SELECT 10.0 a, -10.0 e, p_partkey * 10.0 c, p_partkey * 20.0 f FROM part), x AS (SELECT min(c) x0, max(f) y1 FROM m)
    SELECT count(DISTINCT (round((x0 - c) / a, 2) - floor(round((x0 - c) / a, 2)), round((y1 - f) / e, 2) - floor(round((y1 - f) / e, 2)))) <= 1 AS aligned FROM m, x""")
def pixel_grid_alignment(spark, sf):
    m = _t(spark, sf, "part").select(F.lit(10.0).alias("a"), F.lit(-10.0).alias("e"), (F.col("p_partkey") * 10.0).alias("c"), (F.col("p_partkey") * 20.0).alias("f"), F.lit(8).alias("height"), F.lit(9).alias("width"))
    return grid.grids_align(m)


@query(f"WITH {LL} SELECT c_custkey, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS zone FROM ll")
def utm_zone(spark, sf):
    return _lonlat(spark, sf).select("c_custkey", crs.utm_zone(F.col("lon")).alias("zone"))


def _utm_sql() -> str:
    n, radius, alpha, _ = crs._series(crs.WGS84[1])
    ecc, k = 2 * n**0.5 / (1 + n), crs.UTM_SCALE * crs.WGS84[0] * radius
    x = "eta" + "".join(f" + {c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(alpha, 1))
    y = "xi" + "".join(f" + {c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(alpha, 1))
    return f"""WITH {LL}, z AS (SELECT c_custkey, radians(lon - ((floor((lon + 180) / 6) + 1) * 6 - 183)) AS l, sin(radians(lat)) AS s FROM ll),
        t AS (SELECT *, sinh(atanh(s) - {ecc!r} * atanh({ecc!r} * s)) AS t FROM z), e AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM t)
        SELECT c_custkey, round({crs.UTM_EAST} + {k!r} * ({x}), 3) AS easting, round({k!r} * ({y}), 3) AS northing FROM e"""


@query(_utm_sql())
def project_utm(spark, sf):
    east, north = crs.to_utm(F.col("lon"), F.col("lat"), crs.utm_zone(F.col("lon")))
    return _lonlat(spark, sf).select("c_custkey", _r(east, 3).alias("easting"), _r(north, 3).alias("northing"))


def _albers_sql() -> str:
    a, e, n, c, rho0 = crs._albers()
    return f"""WITH {LL}, q AS (SELECT c_custkey, lon, {1 - e * e!r} * (sin(radians(lat)) / (1 - {e * e!r} * sin(radians(lat)) * sin(radians(lat))) - ln((1 - {e!r} * sin(radians(lat))) / (1 + {e!r} * sin(radians(lat)))) / {2 * e!r}) AS q FROM ll),
        r AS (SELECT c_custkey, {a / n!r} * sqrt({c!r} - {n!r} * q) AS rho, {n!r} * radians(lon + 96.0) AS th FROM q) SELECT c_custkey, round(rho * sin(th), 3) AS x, round({rho0!r} - rho * cos(th), 3) AS y FROM r"""


@query(_albers_sql())
def project_albers(spark, sf):
    x, y = crs.to_albers(F.col("lon"), F.col("lat"))
    return _lonlat(spark, sf).select("c_custkey", _r(x, 3).alias("x"), _r(y, 3).alias("y"))


@query(f"WITH {LL} SELECT c_custkey, round(lon, 6) AS lon_utm, round(lat, 6) AS lat_utm, round(lon, 6) AS lon_albers, round(lat, 6) AS lat_albers FROM ll")
def unproject_round_trip(spark, sf):
    zone = crs.utm_zone(F.col("lon"))
    u, a = crs.from_utm(*crs.to_utm(F.col("lon"), F.col("lat"), zone), zone), crs.from_albers(*crs.to_albers(F.col("lon"), F.col("lat")))
    return _lonlat(spark, sf).select("c_custkey", *(_r(v).alias(n) for n, v in zip(("lon_utm", "lat_utm", "lon_albers", "lat_albers"), (*u, *a))))


# Depth layers: line numbers 1-6 are the six layers; mean, p5, p95 from the measures.
_LAYER = "lay AS (SELECT * FROM (VALUES (1, 0, 5), (2, 5, 15), (3, 15, 30), (4, 30, 60), (5, 60, 100), (6, 100, 200)) AS t(k, top, bottom))"
_SOIL_PX = f"{_LAYER}, s AS (SELECT l_linenumber AS k, l_orderkey % 32 AS r, l_partkey % 32 AS c, max(l_discount) AS m, min(l_tax) - 1 AS p5, max(l_tax) + l_linenumber * 0.01 AS p95 FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1, 2, 3), d AS (SELECT s.*, least(45, bottom) - greatest(10, top) AS w FROM s JOIN lay USING (k) WHERE 10 < bottom AND 45 > top)"


def _soil_layers(spark: SparkSession, sf: str, props: tuple[str, ...] = ("x",)) -> DataFrame:
    rows = _t(spark, sf, "lineitem").filter("l_linenumber <= 6").groupBy(F.col("l_linenumber").alias("k"), (F.col("l_orderkey") % 32).alias("row"), (F.col("l_partkey") % 32).alias("col"))
    rows = rows.agg(F.max("l_discount").alias("mean"), (F.min("l_tax") - 1).alias("p5"), (F.max("l_tax") + F.first("l_linenumber") * 0.01).alias("p95"))
    edge = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in soil_math.LAYERS)), F.col("k").cast("int"))
    return rows.select(F.explode(F.array(*map(F.lit, props))).alias("property"), edge(0).alias("top"), edge(1).alias("bottom"), "row", "col", "mean", "p5", "p95")


@query(f"WITH {_LAYER} SELECT p_partkey, top, bottom, least(p_size + 20, bottom) - greatest(p_size, top) AS weight FROM part JOIN lay ON p_size < bottom AND p_size + 20 > top")
def depth_overlap(spark, sf):
    layers = spark.createDataFrame(list(soil_math.LAYERS), "top int, bottom int")
    p = _t(spark, sf, "part")
    out = p.join(F.broadcast(layers), (F.col("p_size") < F.col("bottom")) & (F.col("p_size") + 20 > F.col("top")))  # six rows
    return out.select("p_partkey", "top", "bottom", (F.least(F.col("p_size") + 20, "bottom") - F.greatest("p_size", "top")).alias("weight"))


@query(f'WITH {_SOIL_PX} SELECT r AS "row", c AS col, CASE WHEN count(*) = 3 THEN round(sum(w * m) / sum(w), 6) END AS mean, CASE WHEN count(*) = 3 THEN round(sqrt(sum(w * w * ((p5 - p95) / 3.29) * ((p5 - p95) / 3.29)) / sum(w * w)), 6) END AS stddev FROM d GROUP BY 1, 2')
def depth_weighted_statistics(spark, sf):
    out = api.depth_statistics(_soil_layers(spark, sf), "x", 10, 45)
    return out.select("row", "col", _r("mean").alias("mean"), _r("stddev").alias("stddev"))


_STOCK = """, o AS (SELECT r, c, CASE WHEN count(*) = 3 THEN 0.58 * sum(w * pow(10, m)) / sum(w) END AS xm, CASE WHEN count(*) = 3 THEN 0.58 * sqrt(sum(w * w * pow((pow(10, p5) - pow(10, p95)) / 3.29, 2)) / sum(w * w)) END AS xs FROM d GROUP BY 1, 2),
    b AS (SELECT r, c, CASE WHEN count(*) = 3 AND count(CASE WHEN m >= 0 THEN m END) = 3 THEN sum(w * m) / sum(w) END AS ym, CASE WHEN count(*) = 3 AND count(CASE WHEN p5 >= 0 AND p95 >= 0 THEN 1 END) = 3 THEN sqrt(sum(w * w * pow((p5 - p95) / 3.29, 2)) / sum(w * w)) END AS ys FROM e GROUP BY 1, 2)"""


@query(f'WITH {_SOIL_PX}, e AS (SELECT k, r, c, m, p5 + 1 AS p5, p95, w FROM d){_STOCK} SELECT r AS "row", c AS col, round(xm * ym, 6) AS mean, round(sqrt(xs * xs * ys * ys + xs * xs * ym * ym + ys * ys * xm * xm), 6) AS stddev FROM o JOIN b USING (r, c)')
def carbon_stock(spark, sf):
    layers = _soil_layers(spark, sf, ("om", "bd")).withColumn("p5", F.when(F.col("property") == "bd", F.col("p5") + 1).otherwise(F.col("p5")))
    return api.carbon_stock(layers, 10, 45).select("row", "col", _r("mean").alias("mean"), _r("stddev").alias("stddev"))


# Scenes: a ship date is a datatake; red, near infrared and class from price, quantity and line number.
_BANDS = """q AS (SELECT strftime(l_shipdate, '%Y%m') AS dt, l_orderkey % 32 AS r, l_partkey % 32 AS c, min(l_suppkey) AS o FROM lineitem GROUP BY 1, 2, 3),
    b AS (SELECT strftime(l_shipdate, '%Y%m') AS dt, l_orderkey % 32 AS r, l_partkey % 32 AS c, floor(min(l_extendedprice) / 20) AS red, floor(max(l_quantity) * 100) AS nir, CAST(max(l_linenumber) + 2 AS INTEGER) AS scl FROM lineitem GROUP BY 1, 2, 3)"""
_IDX = "i AS (SELECT dt, r, c, CASE WHEN scl IN (3, 8, 9, 10) THEN NULL ELSE (nullif(nir, 0) - nullif(red, 0)) / nullif(nir + red, 0) END AS v FROM b)"


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    b = _t(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMM").alias("datatake"), (F.col("l_orderkey") % 32).alias("row"), (F.col("l_partkey") % 32).alias("col"))
    b = b.agg(F.floor(F.min("l_extendedprice") / 20).alias("B04"), F.floor(F.max("l_quantity") * 100).alias("B08"), (F.max("l_linenumber") + 2).alias("SCL"))
    return b.select(F.lit("EPSG:32614").alias("crs"), "datatake", F.lit(0).alias("source_ord"), "row", "col", F.explode(F.create_map(*(x for k in ("B04", "B08", "SCL") for x in (F.lit(k), F.col(k).cast("double"))))).alias("band", "value"))


def _full_bands(spark: SparkSession, sf: str) -> DataFrame:
    # The class of a 20 m cell is copied to four 10 m cells; here the bands of one corner of each cell are given.
    b = _bands(spark, sf)
    fine = F.when(F.col("band") == "SCL", F.col("row")).otherwise(F.col("row") * 2), F.when(F.col("band") == "SCL", F.col("col")).otherwise(F.col("col") * 2)
    return b.withColumns({"row": fine[0], "col": fine[1]})


@query(f'WITH {_BANDS}, {_IDX} SELECT dt AS datatake, r * 2 AS "row", c * 2 AS col, round(v, 9) AS value FROM i')
def ndvi_by_datatake(spark, sf):
    return ndvi.datatake_index(_full_bands(spark, sf)).select("datatake", "row", "col", _r("value", 9).alias("value"))


@query(f'WITH {_BANDS}, {_IDX} SELECT r * 2 AS "row", c * 2 AS col, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS stddev FROM i GROUP BY 1, 2')
def ndvi_monthly_stats(spark, sf):
    out = api.vegetation(_full_bands(spark, sf))
    return out.select("row", "col", *(_r(s).alias(s) for s in ndvi.STATS))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber + 2 IN (3, 8, 9, 10) THEN NULL ELSE nullif(l_discount, 0) / 10000 END AS value FROM lineitem")
def cloud_mask(spark, sf):
    v = soil_math.reflectance(soil_math.clear(F.col("l_linenumber") + 2, F.col("l_discount")))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("value"))


@query(f'WITH {_BANDS} SELECT dt AS datatake, band, r AS "row", c AS col, CASE WHEN band = \'SCL\' OR (r + c) % 3 > 0 THEN v END AS value FROM (SELECT dt, r, c, \'B04\' AS band, red AS v FROM b UNION ALL SELECT dt, r, c, \'B08\', nir FROM b UNION ALL SELECT dt, r, c, \'SCL\', scl FROM b)')
def footprint_mask(spark, sf):
    b = _bands(spark, sf).withColumn("tile_id", F.lit("14TMM"))
    foot = b.filter("band <> 'SCL'").withColumn("value", F.when((F.col("row") + F.col("col")) % 3 > 0, 1.0))
    return ndvi.footprint_masked(b, foot).select("datatake", "band", "row", "col", "value")


@query(f'WITH {_FIRST_SQL} SELECT r * 2 + i AS "row", c * 2 + j AS col, v AS value FROM f, range(2) AS a(i), range(2) AS b(j)')
def scl_upsample(spark, sf):
    return raster.upsampled(_first(spark, sf)).select("row", "col", "value")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate + INTERVAL 1 HOUR <= TIMESTAMP '1997-02-28'")
def scene_filter_month(spark, sf):
    s = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 1 hour")).alias("end"))
    return names.month_scenes(s, 1997, 2, limit=None).select("o_orderkey")


_SCENE_SQL = "SELECT c_custkey, concat('S2C_MSIL2A_', ts, '_N9905_R', lpad(CAST(c_custkey % 143 AS VARCHAR), 3, '0'), '_T', lpad(CAST(1 + c_nationkey AS VARCHAR), 2, '0'), 'SFG_20241216T221754.SAFE') AS name, ts, c_nationkey FROM (SELECT *, concat('202412', lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0'), 'T184831') AS ts FROM customer)"


@query(f"WITH s AS ({_SCENE_SQL}) SELECT c_custkey, concat(lpad(CAST(1 + c_nationkey AS VARCHAR), 2, '0'), 'SFG') AS tile_id, ts AS datatake, CAST(c_custkey % 143 AS INTEGER) AS orbit, CAST(1 + c_nationkey AS INTEGER) AS utm_zone, concat('EPSG:326', lpad(CAST(1 + c_nationkey AS VARCHAR), 2, '0')) AS crs FROM s")
def parse_scene_name(spark, sf):
    ts = F.format_string("202412%02dT184831", 1 + F.col("c_custkey") % 28)
    name = F.concat(F.lit("S2C_MSIL2A_"), ts, F.format_string("_N9905_R%03d_T%02dSFG_20241216T221754.SAFE", F.col("c_custkey") % 143, 1 + F.col("c_nationkey")))
    return _t(spark, sf, "customer").select("c_custkey", names.scene(name).alias("s")).select("c_custkey", "s.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN '14TMM' END AS tile_id, CASE WHEN p_size % 3 < 2 THEN '20240901T172859' END AS datatake, CASE WHEN p_size % 3 < 2 THEN CASE WHEN p_size % 2 = 0 THEN 'B04' ELSE 'SCL' END END AS band,
    CAST(CASE p_size % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 END AS INTEGER) AS resolution, CASE WHEN p_size % 3 = 2 THEN CASE WHEN p_size % 2 = 0 THEN 'B04' ELSE 'SCL' END END AS mask_band FROM part""")
def parse_raster_name(spark, sf):
    band = F.when(F.col("p_size") % 2 == 0, "B04").otherwise("SCL")
    name = F.when(F.col("p_size") % 3 == 2, F.concat(F.lit("MSK_DETFOO_"), band, F.lit(".jp2"))).otherwise(F.concat(F.lit("T14TMM_20240901T172859_"), band, F.lit("_"), F.when(F.col("p_size") % 3 == 0, "10").otherwise("20"), F.lit("m.jp2")))
    return _t(spark, sf, "part").select("p_partkey", names.raster(name).alias("r"), names.footprint_band(name).alias("mask_band")).select("p_partkey", "r.*", "mask_band")


_HREF = "href=\"([^\"]*)\""


@query(f"SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href FROM pages")
def manifest_style_hrefs(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("href"))


@query("SELECT hu4, max_by(key, ord) AS key FROM (SELECT lpad(CAST(c_nationkey * 100 AS VARCHAR), 4, '0') AS hu4, concat('x/NHDPLUS_H_', lpad(CAST(c_nationkey * 100 AS VARCHAR), 4, '0'), '_HU4_2020', lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0'), '_RASTER.zip') AS key, c_custkey AS ord FROM customer) GROUP BY 1")
def newest_archives(spark, sf):
    key = F.format_string("x/NHDPLUS_H_%04d_HU4_2020%04d_RASTER.zip", F.col("c_nationkey") * 100, F.col("c_custkey") % 1000)
    return names.newest_archives(_t(spark, sf, "customer").select(key.alias("key"), F.col("c_custkey").alias("ord")))


# Soil survey: nation = map unit, customer = component, lineitem of its orders = horizon, part = fragment.
_SOIL = """prim AS (SELECT * FROM (SELECT c_nationkey AS mukey, c_custkey AS cokey, c_acctbal AS pct, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_mktsegment <> 'HOUSEHOLD') WHERE n = 1),
    li AS (SELECT o_custkey AS cokey, 10.0 * (l_linenumber - 1) AS top, 10.0 * (l_linenumber - 1) + 10 + l_quantity AS bottom, nullif(l_discount, 0) AS d, l_tax AS t, l_extendedprice AS p, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    h AS (SELECT li.*, least(30, bottom) - greatest(0, top) AS w, p_size AS vol, CASE WHEN p_size >= 10 THEN p_type END AS kind FROM li JOIN prim USING (cokey) LEFT JOIN part ON l_partkey = p_partkey WHERE bottom > 0 AND top < 30),
    agg AS (SELECT cokey, round(sum(w * d) / sum(CASE WHEN d IS NOT NULL THEN w END), 6) AS discount, round(sum(w * t) / sum(w), 6) AS tax, round(sum(w * p) / sum(w), 4) AS price, round(sum(w * vol) / sum(CASE WHEN vol IS NOT NULL THEN w END), 6) AS volume, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM h GROUP BY 1)"""


def _soil_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    unit = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("mukey"), F.col("n_name").alias("muname"))
    comp = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("mukey"), F.col("c_custkey").alias("cokey"), F.col("c_acctbal").alias("comppct_r"), F.when(F.col("c_mktsegment") != "HOUSEHOLD", "Yes").otherwise("No").alias("majcompflag"))
    group = _t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("cokey"), F.lit("Yes").alias("rvindicator"), F.col("r_name").alias("pmgroupname"))
    return unit, comp, group


@query("WITH " + _SOIL + " SELECT n_nationkey AS mukey, cokey, round(pct, 2) AS percent FROM nation LEFT JOIN prim ON mukey = n_nationkey")
def primary_component(spark, sf):
    return soil.primary_components(*_soil_tables(spark, sf)).select("mukey", "cokey", _r("comppct_r", 2).alias("percent"))


@query("WITH " + _SOIL + " SELECT n_nationkey AS mukey, n_name AS name, prim.cokey AS cokey, discount, tax, price, volume, kinds FROM nation LEFT JOIN prim ON mukey = n_nationkey LEFT JOIN agg ON agg.cokey = prim.cokey")
def soil_components(spark, sf):
    """Flagship: primary components with depth-weighted measures and fragment kinds, by the library's own entry point."""
    out = api.soil_components(soil_survey_tables(spark, sf), 0, 30)
    return out.select(
        "mukey", F.col("muname").alias("name"), "cokey", _r("sand_percent_of_fine_fraction_by_weight").alias("discount"), _r("silt_percent_of_fine_fraction_by_weight").alias("tax"),
        _r("clay_percent_of_fine_fraction_by_weight", 4).alias("price"), _r("fragment_percent_by_volume").alias("volume"), F.col("fragment_kind").alias("kinds"),
    )


def soil_survey_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The survey's tables: a line item of a customer's orders is a horizon with its part as the only fragment."""
    unit, comp, _ = _soil_tables(spark, sf)
    group = _t(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("cokey"), F.lit("Yes").alias("rvindicator"), F.col("c_mktsegment").alias("pmgroupname"))
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("chkey")
    li = _t(spark, sf, "lineitem")
    top = 10.0 * (F.col("l_linenumber") - 1)
    horizon = li.select(key, "*").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "chkey", F.col("o_custkey").alias("cokey"), top.alias("hzdept_r"), (top + 10 + F.col("l_quantity")).alias("hzdepb_r"), (F.col("l_tax") * 100).alias("fraggt10_r"), F.col("l_linenumber").cast("double").alias("frag3to10_r"),
        (100 - F.col("l_quantity")).alias("sieveno10_r"), F.nullif("l_discount", F.lit(0.0)).alias("sandtotal_r"), F.col("l_tax").alias("silttotal_r"), F.col("l_extendedprice").alias("claytotal_r"), F.col("l_quantity").alias("om_r"), F.col("l_discount").alias("dbovendry_r"))
    frags = li.select(key, "l_partkey").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("chkey", F.col("p_size").alias("fragvol_r"), F.lit(None).cast("double").alias("fragsize_r"), F.when(F.col("p_size") >= 10, F.col("p_type")).alias("fragkind"))
    return {"mapunit": unit, "component": comp, "copmgrp": group, "chorizon": horizon, "chfrags": frags}


@query("SELECT l_orderkey AS horizon_key, sum(CASE WHEN p_size >= 10 THEN p_size ELSE 0 END) + 0.0 AS volume, string_agg(DISTINCT CASE WHEN p_size >= 20 THEN p_type END, ', ' ORDER BY CASE WHEN p_size >= 20 THEN p_type END) AS kinds FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def fragments_by_horizon(spark, sf):
    f = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    f = f.select(F.col("l_orderkey").alias("horizon_key"), F.when(F.col("p_size") >= 10, F.col("p_size").cast("double")).alias("fragment_percent_by_volume"), F.when(F.col("p_size") >= 20, F.col("p_type")).alias("fragment_kind"))
    return soil.fragments_by_horizon(f).select("horizon_key", F.col("fragment_percent_by_volume").alias("volume"), F.nullif(F.array_join(F.array_sort("kinds"), ", "), F.lit("")).alias("kinds"))


# Catchments: part sizes are codes, those divisible by 7 are missing from the side table.
_CODES = "t AS (SELECT DISTINCT p_size AS value, 21001200000000 + p_size * 100 AS id FROM part WHERE p_size % 7 <> 0)"


def _coded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = _t(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("col"), F.lit(0).alias("row"), F.col("p_size").cast("double").alias("value")), p.filter("p_size % 7 <> 0").select(F.col("p_size").alias("value"), F.format_string("%d", 21001200000000 + F.col("p_size").cast("long") * 100).alias("id")).distinct()


@query(f"WITH {_CODES} SELECT p_partkey AS col, t.id AS value FROM part LEFT JOIN t ON p_size = t.value")
def catchment_recode(spark, sf):
    return raster.recode(*_coded(spark, sf))[0].select("col", "value")


@query("SELECT DISTINCT p_size + 0.0 AS value FROM part WHERE p_size % 7 = 0")
def unmapped_codes(spark, sf):
    return raster.recode(*_coded(spark, sf))[1]


@query("SELECT p_size AS value, CAST(sum(l_linenumber) AS BIGINT) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def catchment_counts(spark, sf):
    return raster.value_counts(_t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_size").alias("value"), F.col("l_linenumber").alias("count")))


_REGION = "g AS (SELECT n_nationkey AS region_id, -125 + n_nationkey * 2.0 AS minx, 25.0 AS miny, -124 + n_nationkey * 2.0 AS maxx, 35.0 AS maxy FROM nation)"
_BOX = f"{LL}, b AS (SELECT c_custkey, lon AS bx0, lat AS by0, lon + 0.7 AS bx1, lat + 0.3 AS by1 FROM ll)"
_MEET = "minx <= bx1 AND maxx >= bx0 AND miny <= by1 AND maxy >= by0"


def _regions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("n_nationkey") * 2.0
    g = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("region_id"), (k - 125).alias("minx"), F.lit(25.0).alias("miny"), (k - 124).alias("maxx"), F.lit(35.0).alias("maxy"))
    return g, _lonlat(spark, sf).select("c_custkey", F.col("lon").alias("minx"), F.col("lat").alias("miny"), (F.col("lon") + 0.7).alias("maxx"), (F.col("lat") + 0.3).alias("maxy"))


@query(f"WITH {_REGION}, {_BOX} SELECT region_id FROM g WHERE EXISTS (SELECT 1 FROM b WHERE {_MEET})")
def region_intersects(spark, sf):
    return geometry.regions_meeting(*_regions(spark, sf)).select("region_id")


@query(f"WITH {_REGION}, {_BOX} SELECT c_custkey FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE {_MEET})")
def region_missing(spark, sf):
    g, b = _regions(spark, sf)
    return geometry.boxes_without_region(b, g).select("c_custkey")


@query(f"WITH {LL} SELECT c_custkey, n_nationkey AS geom_id FROM ll JOIN nation ON lon >= -125 + n_nationkey * 2.0 AND lon < -122.5 + n_nationkey * 2.0 AND lat > 25.5 AND lat <= 35.5")
def points_in_polygons(spark, sf):
    ring = lambda i: [[(-125 + i * 2.0, 25.5), (-122.5 + i * 2.0, 25.5), (-122.5 + i * 2.0, 35.5), (-125 + i * 2.0, 35.5), (-125 + i * 2.0, 25.5)]]
    shapes = geometry.polygons(spark, [(i, ring(i)) for i in range(25)])
    p = _lonlat(spark, sf).select("c_custkey", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return geometry.points_in_polygons(p, shapes).select("c_custkey", F.col("geom_id").cast("int").alias("geom_id"))


@query(f"WITH {LL} SELECT c_custkey FROM ll WHERE abs(lon + 100) <= 1.5 AND lat BETWEEN 28.5 AND 41.5")
def orbit_swath(spark, sf):
    track = F.array(*(F.struct(F.lit(-100.0).alias("x"), F.lit(y).alias("y")) for y in (30.0, 35.0, 40.0)))
    return _lonlat(spark, sf).filter(geometry.near_track(F.col("lon"), F.col("lat"), track, 1.5)).select("c_custkey")


_TARGET = {"a": 64 / 24, "c": 0.0, "e": -64 / 24, "f": 64.0, "height": 24, "width": 24, "crs": "EPSG:32614"}


def _over(cells: int) -> str:
    """Source cells over each of ``cells`` x ``cells`` target cells, with the part that the target cell has."""
    s = f"CAST(64.0 / {cells} AS DOUBLE)"
    return f"""o AS (SELECT i AS "row", j AS col, v, (least(r + 1, (i + 1) * {s}) - greatest(r, i * {s})) * (least(c + 1, (j + 1) * {s}) - greatest(c, j * {s})) AS w
        FROM f JOIN range({cells}) AS a(i) ON r < (i + 1) * {s} AND r + 1 > i * {s} JOIN range({cells}) AS b(j) ON c < (j + 1) * {s} AND c + 1 > j * {s}), u AS (SELECT * FROM o WHERE w > 1e-9)"""


_VALID = "sum(w) FILTER (WHERE v IS NOT NULL)"
_AREA_SQL = {"average": f"sum(w * v) / {_VALID}", "max": "max(v)", "min": "min(v)", "sum": "sum(w * v)", "rms": f"sqrt(sum(w * v * v) / {_VALID})"}
_BELOW = ", e AS (SELECT \"row\", col, v, sum(w) AS w FROM u GROUP BY 1, 2, 3), q AS (SELECT *, sum(CASE WHEN v IS NOT NULL THEN w END) OVER (PARTITION BY \"row\", col ORDER BY v NULLS LAST) AS below, sum(CASE WHEN v IS NOT NULL THEN w END) OVER (PARTITION BY \"row\", col) AS whole FROM e)"


def _resample_query(method: str, name: str, cells: int) -> None:
    """A grid of ``cells`` x ``cells`` over 64 x 64: neither whole multiples of the source's cells nor whole parts of them."""
    target = {"a": 64 / cells, "c": 0.0, "e": -64 / cells, "f": 64.0, "height": cells, "width": cells, "crs": "EPSG:32614"}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return raster.reproject(_first(spark, sf), _meta(spark), target, method).select("row", "col", _r("value", 10).alias("value"))

    run.__name__ = f"{name}_{method}"
    head = f"WITH {_FIRST_SQL}, {_over(cells)}"
    if method in raster.QUANTILES:
        sql = f'{head}{_BELOW} SELECT "row", col, min(CASE WHEN below >= ({raster.QUANTILES[method]} - 1e-9) * whole THEN v END) AS value FROM q GROUP BY 1, 2'
    elif method == "mode":
        sql = f'{head}, n AS (SELECT "row", col, v, round(sum(w), 9) AS k FROM u GROUP BY 1, 2, 3) SELECT "row", col, arg_min(v, (-k, v)) FILTER (WHERE v IS NOT NULL) AS value FROM n GROUP BY 1, 2'
    else:
        sql = f'{head} SELECT "row", col, round({_AREA_SQL[method]}, 10) AS value FROM u GROUP BY 1, 2'
    query(sql)(run)


for _method in (*raster.AREA, *raster.QUANTILES, "mode"):
    _resample_query(_method, "resample", 24)
    _resample_query(_method, "resample_finer", 96)


@query(f'WITH {_FIRST_SQL}, g AS (SELECT i AS "row", j AS col, CAST(floor((i + 0.5) * (64.0 / 24)) AS BIGINT) AS r, CAST(floor((j + 0.5) * (64.0 / 24)) AS BIGINT) AS c FROM range(24) AS a(i), range(24) AS b(j)) SELECT "row", col, v AS value FROM g JOIN f USING (r, c)')
def reproject_nearest(spark, sf):
    return raster.reproject(_first(spark, sf), _meta(spark), _TARGET, "nearest").select("row", "col", "value")


@query(f"""WITH {_FIRST_SQL}, g AS (SELECT i, j, (i + 0.5) * (64.0 / 24) AS y, (j + 0.5) * (64.0 / 24) AS x FROM range(24) AS a(i), range(24) AS b(j)),
    w AS (SELECT i, j, v, greatest(0, 1 - abs(y - r - 0.5)) * greatest(0, 1 - abs(x - c - 0.5)) AS w FROM g JOIN f ON abs(y - r - 0.5) <= 1 AND abs(x - c - 0.5) <= 1 WHERE v IS NOT NULL)
    SELECT i AS "row", j AS col, round(sum(w * v) / nullif(sum(w), 0), 10) AS value FROM w GROUP BY 1, 2 HAVING sum(w) > 0""")
def reproject_bilinear(spark, sf):
    return raster.reproject(_first(spark, sf), _meta(spark), _TARGET, "bilinear").filter("value is not null").select("row", "col", _r("value", 10).alias("value"))


@query("SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'SINK' WHEN 1 THEN 'E' WHEN 2 THEN 'SE' WHEN 4 THEN 'S' WHEN 8 THEN 'SW' END AS direction FROM part")
def flow_direction(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", soil_math.flow_direction(F.col("p_size") % 10).alias("direction"))


@query(f'WITH {_FIRST_SQL}, o AS (SELECT r, c, arg_max(v, source_ord) FILTER (WHERE v IS NOT NULL) AS w FROM px GROUP BY 1, 2) SELECT r AS "row", c AS col, round(v * w, 6) AS value FROM f JOIN o USING (r, c)')
def map_algebra(spark, sf):
    p = _pixels(spark, sf)
    return raster.algebra(raster.merge(p, "first"), raster.merge(p, "last"), lambda a, b: a * b).select("row", "col", _r("value").alias("value"))


@query("SELECT date_trunc('day', ts) AS start, event_type, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS stddev FROM events GROUP BY 1, 2")
def windowed_statistics(spark, sf):
    out = windows.windowed_statistics(_t(spark, sf, "events"), "event_type", "value")
    return out.select("start", "event_type", _r("mean").alias("mean"), "min", "max", _r("stddev").alias("stddev"))
