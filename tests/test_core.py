"""Operators on the small literal arrays and recorded tables of FIXTURES.md."""

import re
import struct
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import crs, grid, names, soil_math
from terravane.operators import geometry, ndvi, raster, soil
from terravane.plans import api
from terravane.sources import files, tiff

NAN = None


def pixels(spark, *arrays, ids=None):
    rows = []
    for k, a in enumerate(arrays):
        for r, line in enumerate(a):
            for c, v in enumerate(line):
                rows.append((ids[k] if ids else str(k), k, 1, r, c, None if v is None else float(v)))
    return spark.createDataFrame(rows, "raster_id string, source_ord int, band int, row long, col long, value double")


def meta(spark, *rows, crs_name="EPSG:5070"):
    return spark.createDataFrame([(i, float(a), 0.0, float(c), 0.0, float(e), float(f), h, w, crs_name) for i, a, c, e, f, h, w in rows], "raster_id string, a double, b double, c double, d double, e double, f double, height long, width long, crs string")


def grid_of(df, n=None, m=None):
    got = {(r["row"], r["col"]): r["value"] for r in df.collect()}
    n, m = n or max(k[0] for k in got) + 1, m or max(k[1] for k in got) + 1
    return [[got.get((i, j)) for j in range(m)] for i in range(n)]


@pytest.mark.parametrize("rule, want", [
    ("first", [[4, 3], [5, 5]]), ("last", [[6, 3], [9, 4]]), ("min", [[4, 3], [5, 4]]), ("max", [[6, 3], [9, 5]]), ("sum", [[10, 3], [14, 9]]),
    ("count", [[2, 1], [2, 2]]), ("mean", [[5, 3], [7, 4.5]]), ("variance", [[1, 0], [4, 0.25]]), ("stddev", [[1, 0], [2, 0.5]]),
])
def test_merge_rules(spark, rule, want):
    p = raster.without_nan(pixels(spark, [[4, 3], [5, 5]], [[6, float("nan")], [9, 4]]))
    assert grid_of(raster.merge(p, rule)) == want
    assert grid_of(raster.merge_variance(p, raster.merge(p, "mean"))) == [[1, 0], [4, 0.25]]


def test_merge_first_fills_gaps_and_custom(spark):
    p = pixels(spark, [[6, None], [9, 4]], [[4, 3], [5, 5]])
    assert grid_of(raster.merge(p)) == [[6, 3], [9, 4]]
    def later(merged, new, merged_mask, new_mask):
        np.copyto(merged, new, where=~new_mask)

    assert grid_of(raster.merge(p, later)) == [[4, 3], [5, 5]]
    assert grid_of(raster.merge(p, lambda stack: np.nanmax(stack, axis=0))) == [[6, 3], [9, 5]]
    with pytest.raises(ValueError):
        raster.merge(p, "nonsense")


OFFSET = ([[0, 1, 2], [4, 5, 6], [8, 9, 10]], [[5, 6, 7], [9, 10, 11], [13, 14, 15]])


def test_mosaic_on_shared_grid(spark):
    p = pixels(spark, *OFFSET)
    m = meta(spark, ("0", 10, -176010, -10, 2390250, 3, 3), ("1", 10, -176000, -10, 2390240, 3, 3))
    flagged = raster.merge_flagged(raster.rebased(p, m))
    assert grid_of(flagged) == [[0, 1, 2, NAN], [4, 5, 6, 7], [8, 9, 10, 11], [NAN, 13, 14, 15]]
    assert flagged.filter("conflict").count() == 0
    other = pixels(spark, OFFSET[0], [[42, 6, 7], *OFFSET[1][1:]])
    assert [tuple(r) for r in raster.merge_flagged(raster.rebased(other, m)).filter("conflict").select("row", "col", "value").collect()] == [(1, 1, 5.0)]


def test_unaligned_sources_raise(spark):
    m = meta(spark, ("0", 10, -176009, -10, 2390251, 3, 3), ("1", 10, -176000, -10, 2390240, 3, 3))
    with pytest.raises(ValueError):
        raster.rebased(pixels(spark, *OFFSET), m)
    assert raster.rebased(pixels(spark, *OFFSET), m, allow_resampling=True).count() == 18


def square(spark, *boxes):
    return geometry.polygons(spark, [(i, [[(a, b), (c, b), (c, d), (a, d), (a, b)]]) for i, (a, b, c, d) in enumerate(boxes)])


@pytest.mark.parametrize("touch", [False, True])
def test_mask_squares(spark, touch):
    p = pixels(spark, [[1] * 4] * 4)
    m = meta(spark, ("0", 1, 0, 1, 0, 4, 4))
    got = raster.mask(p, m, square(spark, (1, 1, 3, 3), (2, 2, 4, 4)), all_touched=touch)
    assert grid_of(got) == [[NAN] * 4, [NAN, 1, 1, NAN], [NAN, 1, 1, 1], [NAN, NAN, 1, 1]]
    assert {(r["row"], r["col"]) for r in raster.mask(p, m, square(spark, (1, 1, 3, 3)), crop=True).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_sample(spark):
    p = pixels(spark, [[6, 0], [9, 4]])
    m = meta(spark, ("0", 1, 0, -1, 0, 2, 2))
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.5, -0.5), (3, 9.0, 9.0)], "point_id long, x double, y double")
    assert {r["point_id"]: r["value"] for r in raster.sample(points, p, m, wrap_negative=True).collect()} == {1: 9, 2: 0, 3: None}
    assert {r["point_id"]: r["value"] for r in raster.sample(points, p, m).collect()} == {1: None, 2: 0, 3: None}


def test_resampling(spark):
    p = pixels(spark, np.arange(16.0).reshape(4, 4).tolist())
    m = meta(spark, ("0", 1, 0, -1, 4, 4, 4))
    target = {"a": 2.0, "c": 0.0, "e": -2.0, "f": 4.0, "height": 2, "width": 2, "crs": "EPSG:5070"}
    want = {"average": [[2.5, 4.5], [10.5, 12.5]], "max": [[5, 7], [13, 15]], "q1": [[0, 2], [8, 10]], "med": [[1, 3], [9, 11]], "sum": [[10, 18], [42, 50]], "bilinear": [[2.5, 4.5], [10.5, 12.5]], "nearest": [[5, 7], [13, 15]]}
    for method, values in want.items():
        assert grid_of(raster.reproject(p, m, target, method)) == values, method
    for method in ("cubic", "cubic_spline", "lanczos", "gauss"):
        got = np.array(grid_of(raster.reproject(p, m, target, method)))
        assert got.shape == (2, 2) and 0 < got[0, 0] < got[1, 1] < 15
    same = {k: m.first()[k] for k in ("a", "c", "e", "f", "crs")} | {"height": 4, "width": 4}
    assert raster.reproject(p, m, same) is p
    with pytest.raises(ValueError):
        raster.reproject(p, m, target, "nonsense")
    origin = spark.range(1).select(*(F.round(raster.aligned_origin(F.lit(3.0), F.lit(v), F.lit(1.0)), 9) for v in (10.5, 10.9))).first()
    assert tuple(origin) == (3.5, 2.9)


def test_align_bounds_and_grids(spark):
    b = dict(zip(("minx", "miny", "maxx", "maxy"), map(F.lit, (-175995.0, 2390215.0, -175975.0, 2390235.0))))
    t = dict(zip("acef", map(F.lit, (10.0, -176010.0, -10.0, 2390250.0))))
    got = spark.range(1).select(*(v.alias(k) for k, v in grid.align_bounds(b, t).items())).first().asDict()
    assert got == {"minx": -176000.0, "maxx": -175970.0, "miny": 2390210.0, "maxy": 2390240.0}
    assert grid.grids_align(meta(spark, ("0", 1, 0, -1, 0, 2, 2), ("1", 1, 0.5, -1, 0, 2, 2))).first()["aligned"] is False


def test_tiles(spark):
    boxes = spark.createDataFrame([(-88.0, 41.5, -87.0, 43.0), (5.0, 5.0, 5.0, 5.0)], "minx double, miny double, maxx double, maxy double")
    assert {tuple(r) for r in grid.grid_cells(grid.snapped_tiles(boxes)).collect()} == {(-88, 41), (-88, 42), (5, 5)}
    row = spark.range(1).select(grid.elevation_tile_name(F.lit(42), F.lit(-88)), grid.soil_tile_path(F.lit("om"), F.lit("p5"), F.lit(5), F.lit(15), F.lit(-88), F.lit(41))).first()
    assert tuple(row) == ("n42w088", "om/p5/5_15/lat4142_lon-88-87.tif")


def test_depth_layers():
    assert [len(soil_math.layers_between(0, e)) for e in (30, 100, 200)] == [3, 5, 6]
    assert soil_math.layers_including(10, 45) == [(5, 15), (15, 30), (30, 60)]
    for bad in (lambda: soil_math.layers_between(0, 99), lambda: soil_math.layers_including(5, 5), lambda: soil_math.layers_including(0, 300)):
        with pytest.raises(ValueError):
            bad()


def test_carbon_stock_needs_every_layer(spark):
    rows = [(p, a, b, 0, c, v if (p, a, c) != ("bd", 5, 1) else -9.0, 1.0, 2.0) for p, v in (("om", 0.0), ("bd", 1.5)) for a, b in ((0, 5), (5, 15)) for c in (0, 1)]
    layers = spark.createDataFrame(rows, "property string, top int, bottom int, row long, col long, mean double, p5 double, p95 double")
    got = {r["col"]: (r["mean"], r["stddev"]) for r in api.carbon_stock(layers, 0, 15).collect()}
    assert got[0][0] == pytest.approx(0.58 * 1.5) and got[0][1] > 0
    assert got[1] == (None, None)


UTM = [(-103.87551445266067, 37.041254047993014, 13, 600000, 4100040), (-102.67138577052769, 36.03410504881955, 13, 709800, 3990240), (-100.21648331498238, 42.44623570214159, 14, 399960, 4700040), (-98.88312689683454, 41.46369251697452, 14, 509760, 4590240)]


def test_projections(spark):
    df = spark.createDataFrame([(a, b, z, float(e), float(n)) for a, b, z, e, n in UTM], "lon double, lat double, zone int, e double, n double")
    e, n = crs.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    for r in df.select("*", e.alias("x"), n.alias("y"), crs.utm_zone(F.col("lon")).alias("z")).collect():
        assert abs(r["x"] - r["e"]) < 2e-3 and abs(r["y"] - r["n"]) < 2e-3 and r["z"] == r["zone"]
    lon, lat = crs.unproject("EPSG:5070", *crs.project("EPSG:5070", F.col("lon"), F.col("lat")))
    for r in df.select("*", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r["a"] - r["lon"]) < 1e-9 and abs(r["b"] - r["lat"]) < 1e-8
    assert tuple(spark.range(1).select(*(F.round(c, 6) for c in crs.to_albers(F.lit(-96.0), F.lit(23.0)))).first()) == (0, 0)
    with pytest.raises(ValueError):
        crs.project("EPSG:3857", F.lit(0.0), F.lit(0.0))


def test_names(spark):
    name = "S2C_MSIL2A_20241216T184831_N9905_R070_T10SFG_20241216T221754.SAFE"
    s = spark.range(1).select(names.scene(F.lit(name)).alias("s"), names.scene(F.lit("x")).alias("o")).first()
    assert tuple(s["s"]) == ("10SFG", "20241216T184831", 70, 10, "EPSG:32610") and s["o"]["tile_id"] is None
    xml = "<a><fileLocation href='./GRANULE/T14TMM_20240901T172859_B04_10m.jp2'/><fileLocation href='./GRANULE/T14TMM_20240901T172859_B04_20m.jp2'/><fileLocation href='./QI/MSK_DETFOO_B08.jp2'/><fileLocation/></a>"
    keys = names.wanted_keys(names.manifest_hrefs(spark.createDataFrame([("S/x.SAFE", xml)], "scene_key string, xml string")))
    assert {r["key"] for r in keys.collect()} == {"S/x.SAFE/GRANULE/T14TMM_20240901T172859_B04_10m.jp2", "S/x.SAFE/QI/MSK_DETFOO_B08.jp2"}
    with pytest.raises(ValueError):
        names.month_scenes(spark.range(1), 2024, 13)


def _tables(spark):
    text = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text()

    def block(head):
        m = re.search(rf"^{re.escape(head)}[^\n]*\n((?:[^\n]*\|[^\n]*\n)+)", text, re.M)
        lines = (head + m[0][len(head):]).strip().split("\n")
        names = lines[0].split("|")
        return [dict(zip(names, line.split("|"))) for line in lines[1:]]

    horizons = block("horizon_key|component_key|top_depth_cm")
    fragments = block("horizon_key|fragment_percent_by_volume")
    number = lambda v: float(v) if v else None
    h = spark.createDataFrame([(int(r["horizon_key"]), int(r["component_key"]), float(r["top_depth_cm"]), float(r["bottom_depth_cm"]), *(number(r[m]) for m in soil.MEASURES)) for r in horizons], "horizon_key long, component_key long, top_depth_cm double, bottom_depth_cm double, " + ", ".join(f"{m} double" for m in soil.MEASURES))
    f = spark.createDataFrame([(int(r["horizon_key"]), number(r["fragment_percent_by_volume"]), r["fragment_kind"] or None) for r in fragments], "horizon_key long, fragment_percent_by_volume double, fragment_kind string")
    return h, f, block("component_key|fine_fraction")


def test_recorded_soil_components(spark):
    h, f, want = _tables(spark)
    got = {r["component_key"]: r for r in soil.horizons_by_component(h, f, 0, 100).collect()}
    assert len(want) == len(got) == 9
    for w in want:
        r = got[int(w["component_key"])]
        cells = list(w.values())
        for m, v in zip([*soil.MEASURES, "fragment_percent_by_volume"], cells[1:9]):
            assert (r[m] is None and v == "") or abs(r[m] - float(v)) < 1e-9
        assert (r["fragment_kind"] or "") == cells[9]
    with pytest.raises(ValueError):
        soil.horizons_by_component(h, f, 10, 10)


def test_primary_components_and_keys(spark):
    unit = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "mukey long, muname string")
    comp = spark.createDataFrame([(1, 10, 60, "Yes"), (1, 11, 60, "Yes"), (1, 12, 90, "No"), (2, 20, 30, "Yes")], "mukey long, cokey long, comppct_r int, majcompflag string")
    group = spark.createDataFrame([(10, "Yes", "loess"), (20, "No", "till")], "cokey long, rvindicator string, pmgroupname string")
    got = [(r["mukey"], r["cokey"], r["parent_material"]) for r in soil.primary_components(unit, comp, group).orderBy("mukey").collect()]
    assert got[:2] == [(1, 10, "loess"), (2, 20, None)] and len(got) == 3
    assert soil.unique_key(unit, "mukey").count() == 4
    with pytest.raises(Exception, match="not unique"):
        soil.unique_key(comp, "mukey").collect()


def test_vegetation(spark):
    rows = [("EPSG:32614", "d1", 0, "SCL", 0, 0, 4.0)] + [("EPSG:32614", "d1", 0, b, r, c, v) for b, v in (("B04", 1000.0), ("B08", 3000.0)) for r, c in ((0, 0), (1, 1))]
    rows += [("EPSG:32614", "d2", 0, "SCL", 0, 0, 9.0), ("EPSG:32614", "d2", 0, "B04", 0, 0, 500.0), ("EPSG:32614", "d2", 0, "B08", 0, 0, 500.0)]
    df = spark.createDataFrame(rows, "crs string, datatake string, source_ord int, band string, row long, col long, value double")
    got = {(r["row"], r["col"]): (r["mean"], r["stddev"]) for r in ndvi.monthly(ndvi.datatake_index(df)).collect()}
    assert got == {k: (pytest.approx(0.5), 0.0) for k in ((0, 0), (1, 1))}
    with pytest.raises(ValueError):
        ndvi.monthly(df, ("stddev",))


def test_geometry(spark):
    ring = geometry.clip_ring([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], 5, 5, 20, 20)
    assert sorted(set(ring)) == [(5, 5), (5, 10), (10, 5), (10, 10)]
    assert geometry.clipped(square(spark, (0, 0, 1, 1), (4, 4, 6, 6)), 5, 5, 9, 9).count() == 1
    assert geometry.minimal_cover([("a", (0, 0, 5, 10)), ("b", (4, 0, 6, 10)), ("d", (5, 0, 10, 10))], [(1, 1, 9, 9)]) == ["a", "d"]
    with pytest.raises(ValueError):
        geometry.minimal_cover([("a", (0, 0, 5, 10))], [(1, 1, 9, 9)])
    holed = geometry.polygons(spark, [(1, [[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)]])])
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.0, 4.0), (3, 20.0, 1.0)], "point_id long, x double, y double")
    assert [r["point_id"] for r in geometry.points_in_polygons(points, holed).collect()] == [1]
    wkt = spark.range(1).select(geometry.wkt_rings(F.lit("MULTIPOLYGON (((0 0, 1.5 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")).alias("r")).first()["r"]
    assert len(wkt) == 2 and tuple(wkt[0][1]) == (1.5, 0.0)


def dbf(rows):
    fields = [(b"Value", 12), (b"COUNT", 16)]
    size = 1 + sum(w for _, w in fields)
    out = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 * len(fields) + 1, size)
    for n, w in fields:
        out += n.ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14
    return out + b"\r" + b"".join(b" " + str(v).encode().rjust(12) + c.encode().rjust(16) for v, c in rows)


def test_sources(spark, tmp_path):
    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":7},"geometry":{"type":"Point","coordinates":[1.5,2.5]}},{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}]}')
    rows = files.geojson(spark, str(tmp_path / "g.geojson")).collect()
    assert [r["geom_type"] for r in rows] == ["Point", "MultiPolygon"] and rows[0]["props"] == {"id": "7"} and rows[0]["crs"] == "EPSG:4326"
    assert tuple(rows[0]["parts"][0][0][0]) == (1.5, 2.5) and len(rows[1]["parts"]) == 2
    for i, extra in enumerate(((), ("b/cat.dbf",))):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            for n in ("a/cat.dbf", *extra):
                z.writestr(n, dbf([(1, "5"), (3, "1.2E+02")]))
    members = files.zip_member(spark, str(tmp_path / "0.zip"), "cat.dbf")
    assert {(r["value"], r["count"]) for r in files.count_tables(members).collect()} == {(1, 5), (3, 120)}
    with pytest.raises(Exception, match="2 members"):
        files.zip_member(spark, str(tmp_path / "1.zip"), "cat.dbf").collect()
    px = np.arange(24.0).reshape(2, 3, 4)
    px[1, 2, 3] = np.nan
    m = {"a": 10.0, "c": 100.0, "e": -10.0, "f": 500.0, "crs": "EPSG:5070"}
    (tmp_path / "r.tif").write_bytes(files.write_tiff(px, m))
    back, got = tiff.read_tiff((tmp_path / "r.tif").read_bytes())
    assert np.array_equal(back, px, equal_nan=True) and {k: got[k] for k in m} == m
    table = tiff.tiff_pixels(spark, str(tmp_path / "r.tif"))
    assert table.count() == 24 and table.filter("value is null").count() == 1 and tiff.tiff_meta(spark, str(tmp_path / "r.tif")).first()["width"] == 4
    files.save_pixels(table, str(tmp_path / "px"))
    assert files.load_window(spark, str(tmp_path / "px"), (0, 1), (1, 2)).count() == 8


def test_recode_and_counts(spark):
    p = pixels(spark, [[1, 2], [3, None]])
    out, lost = raster.recode(p, spark.createDataFrame([(1, "21001200027800"), (2, "x")], "value int, id string"))
    assert grid_of(out) == [[21001200027800, None], [None, None]] and sorted(r["value"] for r in lost.collect()) == [2, 3]
    raster.same_shape(meta(spark, ("0", 1, 0, -1, 0, 2, 2)))
    with pytest.raises(ValueError):
        raster.same_shape(meta(spark, ("0", 1, 0, -1, 0, 2, 2), ("1", 1, 0, -1, 0, 2, 3)))


def test_facade(spark):
    points = spark.createDataFrame([(1, 0.5, 1.5), (2, 7.0, 7.0)], "point_id long, x double, y double")
    p = pixels(spark, [[6, 0], [9, 4]])
    sources = {"elevation_pixels": p, "elevation_meta": meta(spark, ("0", 1, 0, -1, 2, 2, 2), crs_name="EPSG:4326"), "soil_polygons": square(spark, (0, 0, 2, 2)), "soil_components": spark.createDataFrame([(0, 372099)], "geom_id long, map_unit_key long")}
    got = {r["point_id"]: (r["usgs_elevation"], r["ssurgo_map_unit_key"]) for r in api.fetch_point_data(points, ["usgs_topography", "ssurgo_primary_component"], sources, end_depth=30).collect()}
    assert got == {1: (6.0, 372099), 2: (None, None)}
    soil_value = ["ssurgo_primary_component"]
    for bad in ({"values": []}, {"values": ["soil"]}, {"values": soil_value}, {"values": ["sentinel2_ndvi"]}, {"values": soil_value, "end_depth": -1}, {"values": soil_value, "start_depth": 30, "end_depth": 30}):
        with pytest.raises(ValueError):
            api.fetch_point_data(points, sources=sources, **bad)
    with pytest.raises(ValueError):
        api.fetch_point_data(points.drop("x"), soil_value, sources, end_depth=30)


def test_stream(spark, tmp_path):
    from terravane.streaming.windows import windowed_statistics

    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 3.0)], "ts string, k string, v double").select(F.to_timestamp("ts").alias("ts"), "k", "v")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_statistics(stream, "k", "v").writeStream.format("memory").queryName("stats").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["mean"], r["stddev"]) for r in spark.table("stats").collect()] == [(2.0, 1.0)]
