"""Large GeoJSON files read by ranges: the same rows as a file read whole, wherever ranges are cut."""

import json

import pytest

from terravane.sources import features, files


def collection(n, **members):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = [{"type": "Point", "coordinates": [1.5, 2.5]}, {"type": "Polygon", "coordinates": [ring]}, {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, None]
    texts = ['a "quoted" {[ name', "back\\slash\\\\", "\\", "", "ünï }]", '"crs": {']
    held = [{"type": "Feature", "properties": {"id": i, "name": texts[i % 6] * (i % 3 + 1), "more": {"type": "Feature"}}, "geometry": shapes[i % 4]} for i in range(n)]
    return {"type": "FeatureCollection", **members, "features": held}


def rows_of(df):
    return sorted((r["geom_id"], r["geom_type"], repr(r["parts"]), r["crs"], tuple(sorted((r["props"] or {}).items()))) for r in df.collect())


@pytest.mark.parametrize("size", [37, 64, 500, 1 << 20])
def test_ranges_of_any_size_give_the_same_features(spark, tmp_path, size):
    doc = collection(14)
    doc["crs"] = {"type": "name", "properties": {"name": "EPSG:5070", "type": "Feature"}}  # after the features
    doc["other"] = {"type": "x", "held": {"type": "Feature"}}
    doc["others"] = [{"type": "Feature", "properties": {"id": 99}}]
    path = tmp_path / "g.geojson"
    path.write_text(json.dumps(doc, ensure_ascii=False, indent=None if size % 2 else 1))
    got = features.split_geojson(spark, str(path), size)
    assert rows_of(got) == rows_of(files.geojson(spark, str(path)))
    assert {r["path"] for r in got.collect()} == {f"file:{path}"} and [r["geom_id"] for r in got.orderBy("geom_id").collect()] == list(range(14))


def test_several_files_and_files_of_nothing(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(collection(5)))
    (tmp_path / "b.geojson").write_text(json.dumps(collection(3, crs={"properties": {"name": "EPSG:32614"}})))
    (tmp_path / "c.geojson").write_text(json.dumps(collection(0)))
    (tmp_path / "d.geojson").write_text("")
    got = {(r["path"][-9:-8], r["geom_id"], r["crs"]) for r in features.split_geojson(spark, str(tmp_path), 200).collect()}
    assert got == {("a", i, "EPSG:4326") for i in range(5)} | {("b", i, "EPSG:32614") for i in range(3)}


@pytest.mark.parametrize("cut", range(1, 12))
def test_nesting_adds_up_at_every_cut(cut):
    text = b'{"a\\\\\\"{":["\\"]",{}]}'
    skip = features._skewed(type("F", (), {"read_at": staticmethod(lambda n, at: text[at : at + n])}), cut)
    one, two = features.nesting(text[:cut]), features.nesting(text[cut + skip :])
    inside = one[0]
    assert (one[0] + two[0]) % 2 == 0 and one[1] + two[1 + inside] == 0
