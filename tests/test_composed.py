"""Entry points that are composed of several catalogues: scenes over geometries, objects by key, order of keys, one façade for all values."""

import pytest
from pyspark.sql import functions as F

from terravane.functions import crs
from terravane.operators import geometry
from terravane.plans import api
from terravane.sources import catalog, files

BOX = "geom_id long, minx double, miny double, maxx double, maxy double"


def boxes(spark, *rows):
    return geometry.boxes_as_polygons(spark.createDataFrame([(i, *map(float, b)) for i, b in rows], BOX))


def tiles(spark, *rows):
    return geometry.boxes_as_polygons(spark.createDataFrame([(n, *map(float, b)) for n, b in rows], "tile_id string, minx double, miny double, maxx double, maxy double"))


def catalogue(spark):
    """Two tiles in zone 14 that both hold the first field, one of them with the second too, and one in zone 15; orbits straight up."""
    held = tiles(spark, ("14AAA", (-100.2, 39.8, -99.4, 40.6)), ("14BBB", (-100.0, 39.8, -98.6, 40.6)), ("15CCC", (-95.6, 39.8, -94.4, 40.6)))
    track = lambda lon: [{"x": lon, "y": float(y)} for y in range(30, 51, 5)]
    orbits = spark.createDataFrame([(7, track(-99.6)), (12, track(-94.9)), (99, track(-80.0))], "orbit int, track array<struct<x:double,y:double>>")
    fields = boxes(spark, (1, (-99.8, 40.0, -99.7, 40.1)), (2, (-98.9, 40.0, -98.8, 40.1)), (3, (-95.0, 40.0, -94.9, 40.1)))
    return held, orbits, fields


def test_fewest_tiles_with_their_orbits_zone_by_zone(spark):
    held, orbits, fields = catalogue(spark)
    got = {tuple(r) for r in catalog.tiles_for_geometries(fields, held, orbits).collect()}
    assert got == {("14BBB", 7), ("15CCC", 12)}
    with pytest.raises(ValueError, match="no geometries"):
        catalog.tiles_for_geometries(fields.limit(0), held, orbits)
    with pytest.raises(ValueError, match="do not cover"):
        catalog.tiles_for_geometries(boxes(spark, (4, (-101.5, 40.0, -101.4, 40.1))).unionByName(fields.filter("geom_id = 1")), held, orbits).collect()


def test_vegetation_over_geometries(spark):
    held, orbits, fields = catalogue(spark)
    name = lambda day, orbit, tile: f"S2C_MSIL2A_202409{day:02d}T172859_N9905_R{orbit:03d}_T{tile}_202409{day:02d}T221754.SAFE"
    scenes = [(name(3, 7, "14BBB"), "2024-09-03 17:28:59"), (name(9, 7, "14BBB"), "2024-09-09 17:28:59"), (name(4, 99, "14BBB"), "2024-09-04 17:28:59"), (name(5, 7, "14AAA"), "2024-09-05 17:28:59"), (name(6, 12, "15CCC"), "2024-10-06 17:28:59")]
    found = spark.createDataFrame(scenes, "name string, at string").select("name", F.to_timestamp("at").alias("start"), (F.to_timestamp("at") + F.expr("interval 1 minute")).alias("end"))
    bands = [(t, day, b, v) for t, day, red, nir in (("14BBB", 3, 1000.0, 3000.0), ("14BBB", 9, 1000.0, 4000.0), ("14BBB", 4, 9000.0, 1.0), ("14AAA", 5, 9000.0, 1.0), ("15CCC", 6, 9000.0, 1.0)) for b, v in (("B04", red), ("B08", nir), ("SCL", 4.0))]
    rows = [("EPSG:32614", t, f"202409{day:02d}T172859", 0, b, 0, 0, v) for t, day, b, v in bands]
    pixels = spark.createDataFrame(rows, "crs string, tile_id string, datatake string, source_ord int, band string, row long, col long, value double")
    got = api.vegetation_of(fields, 2024, 9, held, orbits, found, pixels).collect()
    # The month's scenes of the chosen tile and its orbit only: indices 0.5 and 0.6.
    assert [(r["row"], r["col"]) for r in got] == [(0, 0)]
    assert (got[0]["mean"], got[0]["min"], got[0]["max"], got[0]["stddev"]) == (pytest.approx(0.55), pytest.approx(0.5), pytest.approx(0.6), pytest.approx(0.05))


def test_objects_by_key(spark, tmp_path):
    for key in ("a/x.bin", "a/b/y.bin", "z.bin"):
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(key.encode())
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r["key"]: bytes(r["content"]) for r in catalog.fetch_objects(spark, root, ["a/x.bin", "/a/b/y.bin"], "a/").collect()}
        assert got == {"a/x.bin": b"a/x.bin", "a/b/y.bin": b"a/b/y.bin"}
    assert catalog.fetch_objects(spark, str(tmp_path), []).count() == 0
    for bad in ("../secret", "a/../../secret", "z.bin"):
        with pytest.raises(ValueError, match="unexpected key"):
            catalog.fetch_objects(spark, str(tmp_path), [bad], "a/")


def test_keys_by_zone_and_datatake(spark):
    name = lambda stamp, tile: f"q/S2C_MSIL2A_{stamp}_N9905_R070_T{tile}_20241216T221754.SAFE"
    keys = [name("20241216T184831", "14TMM"), name("20241201T184831", "14TMM"), name("20241220T184831", "10SFG"), name("20241201T184831", "14TAA")]
    got = [r["scene_key"] for r in catalog.keys_in_order(spark.createDataFrame([(k,) for k in keys], "scene_key string")).collect()]
    assert got == [keys[2], keys[3], keys[1], keys[0]]


def test_moving_there_and_back(spark):
    places = spark.createDataFrame([(-99.5 + i / 7, 40.0 - i / 5) for i in range(20)], "x double, y double").withColumn("at", F.struct("x", "y"))
    for system in ("EPSG:32614", "EPSG:5070", "EPSG:4269", "EPSG:32714"):
        back = crs.moved(crs.moved(places, "EPSG:4326", system), system, "EPSG:4326")
        assert all(abs(r["x"] - r["at"]["x"]) < 1e-8 and abs(r["y"] - r["at"]["y"]) < 1e-7 for r in back.collect())
    mixed = places.withColumn("crs", F.when(F.col("x") > -98, "EPSG:5070").otherwise("EPSG:32614"))
    one = crs.moved_each(mixed, ["EPSG:5070", "EPSG:32614"], "crs", "EPSG:4326", back=True)
    for r in crs.moved_each(one, ["EPSG:5070", "EPSG:32614"], "crs", "EPSG:4326").collect():
        assert abs(r["x"] - r["at"]["x"]) < 1e-8 and abs(r["y"] - r["at"]["y"]) < 1e-7
    # A filter on the results is not written out as a formula of the inputs.
    twice = crs.moved(crs.moved(places, "EPSG:4326", "EPSG:32614"), "EPSG:32614", "EPSG:5070").filter("x is not null and x > y")
    assert len(twice._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    with pytest.raises(ValueError):
        crs.moved(places, "EPSG:4326", "EPSG:3857")


def test_scratch_is_read_again(spark):
    df = files.stored(spark.range(5), "five")
    assert df.count() == 5 and "Scan parquet" in df._jdf.queryExecution().executedPlan().toString()
