"""Rasters in files: tiled writes, window reads by ranges, commit and abort."""

import pathlib

import numpy as np
import pytest

from terravane.sources import files, tiff

COLUMNS = "raster_id string, band int, row long, col long, value double"
META = "raster_id string, a double, b double, c double, d double, e double, f double, height long, width long, crs string"


def cells_of(arrays):
    """Cells of {raster: array (bands, rows, columns)} as rows; NaN is null."""
    return [(k, b + 1, y, x, None if np.isnan(v) else float(v)) for k, a in arrays.items() for (b, y, x), v in np.ndenumerate(a)]


def written(spark, folder, arrays, metas, **options):
    tiff.write_tiffs(spark.createDataFrame(cells_of(arrays), COLUMNS).repartition(3), spark.createDataFrame(metas, META), str(folder), **options)
    return {str(p.relative_to(folder))[:-4]: p for p in pathlib.Path(folder).rglob("*.tif")}


def random_array(seed, *shape):
    r = np.random.default_rng(seed)
    out = r.normal(size=shape).round(3)
    out[r.random(shape) < 0.2] = np.nan
    return out


def one(height, width, name="a"):
    return (name, 10.0, 0.0, 100.0, 0.0, -10.0, 500.0, height, width, "EPSG:32614")


@pytest.mark.parametrize("big", [None, True])
def test_rasters_come_back(spark, tmp_path, big):
    arrays = {"EPSG=32614/mean": random_array(1, 3, 50, 37), "b": random_array(2, 1, 16, 16)}
    arrays["EPSG=32614/mean"][1, 16:32] = np.nan  # whole tiles without values
    metas = [("EPSG=32614/mean", 10.0, 0.0, 100.0, 0.0, -10.0, 500.0, 50, 37, "EPSG:32614"), ("b", 0.5, 0.25, -3.0, 0.125, -2.0, 7.0, 16, 16, None), ("none", 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 20, 5, "EPSG:4326")]
    paths = written(spark, tmp_path, arrays, metas, tile=16, big=big)
    assert set(paths) == {"EPSG=32614/mean", "b", "none"} and [p for p in (tmp_path / "_temporary").rglob("*")] == []
    for m in metas:
        got, meta = tiff.read_tiff(paths[m[0]].read_bytes())
        want = arrays.get(m[0], np.full((1, 20, 5), np.nan))
        assert np.array_equal(got, want, equal_nan=True)
        assert tuple(meta[c] for c in "a b c d e f height width crs".split()) == m[1:]
    table = tiff.tiff_pixels(spark, str(tmp_path))
    assert dict(table.dtypes) == {"raster_id": "string", "band": "int", "row": "bigint", "col": "bigint", "value": "double"}
    assert {(r["raster_id"], r["band"], r["row"], r["col"], r["value"]) for r in table.filter("raster_id not like '%none%'").collect()} == {(f"file:{paths[k]}", *rest) for k, *rest in cells_of(arrays)}
    assert {r["raster_id"]: (r["bands"], r["crs"]) for r in tiff.tiff_meta(spark, str(tmp_path)).collect()} == {f"file:{paths[m[0]]}": (len(arrays.get(m[0], [0])), m[9]) for m in metas}


def test_a_window_reads_its_tile_only(spark, tmp_path):
    array = random_array(3, 1, 64, 64)
    path = written(spark, tmp_path, {"a": array}, [one(64, 64)], tile=32)["a"]
    data = path.read_bytes()
    sizes = []
    t = tiff.Tiff(lambda at, size: sizes.append(size) or data[at : at + size])
    header = sum(sizes)
    (number, band, top, left), = t.blocks((40, 50), (5, 20), (1, 1))
    t.values(number, top, left)
    assert (number, band, top, left) == (2, 1, 32, 0) and sum(sizes) - header == t.sizes[2] and sum(sizes) < len(data) / 2
    # All other tiles are spoilt: whoever read them would fail.
    for i in (0, 1, 3):
        data = data[: t.offsets[i]] + b"\xff" * t.sizes[i] + data[t.offsets[i] + t.sizes[i] :]
    path.write_bytes(data)
    want = {(r, c): v for _, _, r, c, v in cells_of({"a": array}) if 40 <= r <= 50 and 5 <= c <= 20}
    found = lambda df: {(r["row"], r["col"]): r["value"] for r in df.collect()}
    assert found(tiff.tiff_pixels(spark, str(path), rows=(40, 50), cols=(5, 20))) == want
    with pytest.raises(Exception):
        tiff.tiff_pixels(spark, str(path)).collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert found(tiff.tiff_pixels(spark, str(path)).filter("row >= 40 and row < 51 and col > 4 and col <= 20 and band = 1")) == want
        assert tiff.tiff_pixels(spark, str(path)).filter("raster_id = 'other'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bounds_floor_and_ceil(spark, tmp_path):
    written(spark, tmp_path, {"a": random_array(4, 1, 40, 40)}, [one(40, 40)], tile=16)
    ends = lambda b: tuple(tiff.tiff_pixels(spark, str(tmp_path / "*.tif"), bounds=b).selectExpr("min(row)", "max(row)", "min(col)", "max(col)").first())
    assert ends((125.0, 305.0, 240.0, 400.0)) == (10, 19, 2, 13)
    assert ends((-50.0, 455.0, 111.0, 900.0)) == (0, 4, 0, 1)
    assert ends((1000.0, 0.0, 1100.0, 50.0)) == (None,) * 4


def test_large_files_are_shared_by_tasks(spark, tmp_path, monkeypatch):
    array = random_array(5, 2, 80, 80)
    path = written(spark, tmp_path, {"a": array}, [one(80, 80)], tile=16)["a"]
    monkeypatch.setattr(tiff, "SHARE", 8_000)
    reader = tiff.TiffReader({"path": str(path)})
    parts = reader.partitions()
    got = [[r for batch in reader.read(p) for r in batch.to_pylist()] for p in parts]
    assert len(parts) > 3 and all(got)
    assert sorted((r["band"], r["row"], r["col"]) for g in got for r in g) == sorted((b, y, x) for _, b, y, x, _ in cells_of({"a": array}))


def test_failed_writes_leave_nothing(spark, tmp_path):
    good = {"a": random_array(6, 1, 16, 16)}
    for bad, metas in (({"b": random_array(7, 1, 4, 4)}, [one(16, 16)]), ({"b": random_array(7, 1, 40, 4)}, [one(16, 16), one(16, 16, "b")]), ({"..": random_array(7, 1, 4, 4)}, [one(16, 16), one(16, 16, "..")])):
        with pytest.raises(Exception, match="no metadata|beyond raster|names no file"):
            written(spark, tmp_path, good | bad, metas, tile=16)
        assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    frame = spark.createDataFrame([("a", 1, None, 0, 1.0)], COLUMNS)
    with pytest.raises(Exception, match="no place in a raster"):
        tiff.write_tiffs(frame, spark.createDataFrame([one(4, 4)], META), str(tmp_path), tile=16)


def test_repeated_cells_other_columns_and_nothing(spark, tmp_path):
    rows = [("a", 1, 0, 0, 1.0, "x"), ("a", 1, 0, 0, 5.0, "y"), ("a", 1, 0, 0, None, "z"), ("a", 1, 1, 1, float("nan"), "z")]
    tiff.write_tiffs(spark.createDataFrame(rows, COLUMNS + ", size string"), spark.createDataFrame([(*one(2, 2), 7)], META + ", trow int"), str(tmp_path / "some"), tile=16)
    got = tiff.tiff_pixels(spark, str(tmp_path / "some")).collect()
    assert sorted((r["row"], r["col"], r["value"]) for r in got if r["value"] is not None) == [(0, 0, 5.0)] and len(got) == 4
    tiff.write_tiffs(spark.createDataFrame([], COLUMNS), spark.createDataFrame([], META), str(tmp_path / "none"), tile=16)
    (tmp_path / "none").mkdir(exist_ok=True)
    assert tiff.tiff_pixels(spark, str(tmp_path / "none")).count() == 0 and tiff.tiff_meta(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        tiff.write_tiffs(spark.createDataFrame([], COLUMNS), spark.createDataFrame([], META), str(tmp_path / "x"), tile=20)


def test_nodata_that_the_type_cannot_hold_masks_nothing():
    assert tiff._nodata("-9999", np.dtype("u1")) is None and tiff._nodata("nan", np.dtype("i2")) is None and tiff._nodata("255", np.dtype("u1")) == 255
    assert tiff._nodata("-3.4e38", np.dtype("f4")) == np.float32(-3.4e38)


def test_strips(spark, tmp_path):
    px = random_array(8, 2, 30, 20)
    (tmp_path / "s.tif").write_bytes(files.write_tiff(px, {"a": 10.0, "c": 100.0, "e": -10.0, "f": 500.0, "crs": "EPSG:5070"}))
    got = {(r["band"], r["row"], r["col"]): r["value"] for r in tiff.tiff_pixels(spark, str(tmp_path / "s.tif"), rows=(3, 9), bands=(2, 2)).collect()}
    assert got == {(b, y, x): v for _, b, y, x, v in cells_of({"s": px}) if b == 2 and 3 <= y <= 9}
