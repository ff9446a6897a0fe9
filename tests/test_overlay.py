"""Overlay, union, covering, shares and projection against brute force and exact arithmetic."""

import itertools
import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import crs
from terravane.operators import geometry, overlay, raster


def shapes(spark, rows):
    """From (geom_id, [part, ...]), a part being a list of rings of (x, y)."""
    data = [(i, [[[{"x": float(x), "y": float(y)} for x, y in (*ring, ring[0])] for ring in part] for part in parts]) for i, parts in rows]
    return spark.createDataFrame(data, f"geom_id long, parts {geometry.PARTS}")


def star(r, x, y, arms):
    at = [(2 * math.pi * k / (2 * arms), r.uniform(3, 6) if k % 2 else r.uniform(0.5, 1.5)) for k in range(2 * arms)]
    return [(round(x + d * math.cos(a), 3), round(y + d * math.sin(a), 3)) for a, d in at]


def crossings(part, y):
    out = []
    for ring in part:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if (ay > y) != (by > y):
                out.append(ax + (bx - ax) * (y - ay) / (by - ay))
    return sorted(out)


def covered(parts, y):
    """Intervals of a line that parts cover, even-odd within a part."""
    spans = sorted((a, b) for part in parts for a, b in itertools.batched(crossings(part, y), 2))
    out = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def area_of(one, other, rule):
    """Exact area by lines between all heights of corners and crossings: the width is linear there, so its middle decides."""
    exact = lambda parts: [[[(Fraction(str(x)), Fraction(str(y))) for x, y in ring] for ring in part] for part in parts]
    one, other = exact(one), exact(other)
    edges = [(a, b) for parts in (one, other) for part in parts for ring in part for a, b in zip(ring, [*ring[1:], ring[0]]) if a[1] != b[1]]
    ys = {p[1] for e in edges for p in e}
    for (a, b), (c, d) in itertools.combinations(edges, 2):
        m, n = (b[0] - a[0]) / (b[1] - a[1]), (d[0] - c[0]) / (d[1] - c[1])
        if m != n:
            y = (c[0] - a[0] + m * a[1] - n * c[1]) / (m - n)
            if max(min(a[1], b[1]), min(c[1], d[1])) < y < min(max(a[1], b[1]), max(c[1], d[1])):
                ys.add(y)
    total = Fraction(0)
    for lo, hi in itertools.pairwise(sorted(ys)):
        p, q = covered(one, (lo + hi) / 2), covered(other, (lo + hi) / 2)
        both = sum((max(Fraction(0), min(b, d) - max(a, c)) for a, b in p for c, d in q), Fraction(0))
        total += (hi - lo) * (both if rule == "common" else sum((b - a for a, b in p), Fraction(0)) - both)
    return float(total)


L_SHAPE = [[[(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]]]
RING = [[[(0, 0), (9, 0), (9, 9), (0, 9)], [(3, 3), (6, 3), (6, 6), (3, 6)]]]


def test_square_cut_to_an_l(spark):
    cut = overlay.clipped_to(shapes(spark, [(1, [[[(0, 0), (2, 0), (2, 2), (0, 2)]]])]), shapes(spark, [(7, L_SHAPE)])).collect()
    assert len(cut) == 1 and cut[0]["area_id"] == 7 and cut[0]["area"] == 3.0


def test_overlay_of_stars_rings_and_several_parts(spark):
    r = random.Random(11)
    left = [(i, [[star(r, r.uniform(0, 20), r.uniform(0, 20), r.randint(3, 7))]]) for i in range(12)]
    left += [(20, RING), (21, [[[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(2, 2), (6, 2), (6, 6), (2, 6)]]]), (22, L_SHAPE)]
    right = [(i, [[star(r, r.uniform(0, 20), r.uniform(0, 20), r.randint(3, 7))], [star(r, r.uniform(0, 20), r.uniform(0, 20), 5)]]) for i in range(8)]
    right += [(30, RING), (31, [[[(1, 1), (8, 1), (8, 8), (1, 8)]]]), (32, [[[(50, 50), (51, 50), (51, 51)]]])]
    cut = overlay.clipped_to(shapes(spark, left), shapes(spark, right)).withColumn("again", F.aggregate(F.transform("parts", geometry.area), F.lit(0.0), lambda a, b: a + b))
    got = {(x["geom_id"], x["area_id"]): x for x in cut.collect()}
    want = {(i, j): area_of(a, b, "common") for i, a in left for j, b in right}
    for k, v in want.items():
        assert (k in got) == (v > 0) and (v == 0 or math.isclose(got[k]["area"], v, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(got[k]["again"], v, rel_tol=1e-9, abs_tol=1e-9)), (k, v, got.get(k))
    assert sum(v > 0 for v in want.values()) > 30
    # Points of the result are those in both.
    points = spark.createDataFrame([(i, r.uniform(0, 12), r.uniform(0, 12)) for i in range(300)], "point_id long, x double, y double")
    one = cut.filter("geom_id = 20 and area_id = 31").select(F.lit(1).cast("long").alias("geom_id"), "parts")
    hit = {x["point_id"] for x in geometry.points_in_polygons(points, one).collect()}
    within = lambda t, x, y: sum(v > x for v in crossings(t[0], y)) % 2 == 1
    assert hit == {p["point_id"] for p in points.collect() if within(RING, p["x"], p["y"]) and 1 <= p["x"] <= 8 and 1 <= p["y"] <= 8}
    some = [b for _, b in right[:4]]
    rest = {x["geom_id"]: x["area"] for x in overlay.without(shapes(spark, left), shapes(spark, right[:4])).collect()}
    for i, a in left:
        v = area_of(a, [part for b in some for part in b], "rest")
        assert math.isclose(rest.get(i, 0.0), v, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("whole, cell, band", [(256, 64, 64), (4, 3, 2)])
def test_union_of_boxes(spark, monkeypatch, whole, cell, band):
    monkeypatch.setattr(overlay, "WHOLE_PARTS", whole)
    monkeypatch.setattr(overlay, "CELL_PARTS", cell)
    monkeypatch.setattr(overlay, "BAND_EDGES", band)
    r = random.Random(3)
    boxes, cells = [], {}
    for i in range(120):
        key, x, y, w, h = i % 3, r.randrange(40), r.randrange(40), r.randint(1, 9), r.randint(1, 9)
        boxes.append((i, key, *map(float, (x, y, x + w, y + h))))
        cells.setdefault(key, set()).update(itertools.product(range(x, x + w), range(y, y + h)))
    # A frame with a hole, made of four boxes.
    for i, (x0, y0, x1, y1) in enumerate(((0, 0, 9, 2), (0, 7, 9, 9), (0, 0, 2, 9), (7, 0, 9, 9)), 200):
        boxes.append((i, 9, *map(float, (x0, y0, x1, y1))))
        cells.setdefault(9, set()).update(itertools.product(range(x0, x1), range(y0, y1)))
    polygons = geometry.boxes_as_polygons(spark.createDataFrame(boxes, "geom_id long, key long, minx double, miny double, maxx double, maxy double"))
    found = overlay.union_pieces(polygons, "key")
    area = {x["key"]: x["a"] for x in found.groupBy("key").agg(F.sum(overlay.piece_area()).alias("a")).collect()}
    assert area == pytest.approx({k: len(v) for k, v in cells.items()})
    long = F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))
    border = {x["key"]: x["n"] for x in overlay.boundary(found, "key").groupBy("key").agg(F.sum(long).alias("n")).collect()}
    assert border == pytest.approx({k: sum((x + dx, y + dy) not in v for x, y in v for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))) for k, v in cells.items()})
    assert border[9] == 4 * 9 + 4 * 5
    union = overlay.dissolved(polygons, "key").withColumnRenamed("key", "geom_id").drop("area")
    at = spark.createDataFrame([(x, y, x + 0.5, y + 0.5) for x in range(50) for y in range(50)], "i long, j long, x double, y double")
    hits = {(p["geom_id"], p["i"], p["j"]) for p in geometry.points_in_polygons(at, union).collect()}
    assert hits == {(k, i, j) for k, v in cells.items() for i, j in v}


def test_empty_overlays(spark):
    some, none = shapes(spark, [(1, RING)]), shapes(spark, [])
    assert overlay.clipped_to(some, none).count() == 0 and overlay.clipped_to(none, some).count() == 0
    assert overlay.without(some, none).first()["area"] == 72 and overlay.without(none, some).count() == 0
    assert overlay.clipped_to(some, shapes(spark, [(2, [[[(9, 0), (12, 0), (12, 5), (9, 5)]]])])).count() == 0


# --- Covering by cells.


def test_points_on_lattice_and_borders(spark):
    r = random.Random(5)
    rows = [(1, L_SHAPE), (2, RING), (3, [[[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(2, 2), (6, 2), (6, 6), (2, 6)]]]), *((i, [[star(r, 4, 4, 5)]]) for i in range(4, 9))]
    at = [(x / 4, y / 4) for x in range(-4, 44) for y in range(-4, 44)] + [(r.uniform(-1, 10), r.uniform(-1, 10)) for _ in range(500)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(-1, None, 1.0)], "point_id long, x double, y double")
    got = {(p["point_id"], p["geom_id"]) for p in geometry.points_in_polygons(points, shapes(spark, rows)).collect()}
    inside = lambda parts, x, y: any(sum(v > x for v in crossings(part, y)) % 2 for part in parts)
    assert got == {(i, k) for i, (x, y) in enumerate(at) for k, parts in rows if inside(parts, float(x), float(y))}


def test_one_huge_polygon_makes_no_hot_key(spark):
    r = random.Random(6)
    points = spark.createDataFrame([(i, r.uniform(-100, 100), r.uniform(-50, 50)) for i in range(20_000)], "point_id long, x double, y double")
    huge = shapes(spark, [(1, [[[(-100, -50), (100, -50), (100, 50), (-100, 50)]]])])
    cells, levels = geometry.covering(huge)
    keys = geometry._keyed_points(points, levels).groupBy("level", "cx", "cy").count()
    assert keys.agg(F.max("count")).first()[0] < 20_000 / 64 and cells.count() < 400
    assert cells.groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0] == 1
    assert geometry.points_in_polygons(points, huge).count() == 20_000
    box = spark.createDataFrame([(1, -100.0, -50.0, 100.0, 50.0)], "box long, minx double, miny double, maxx double, maxy double")
    assert geometry.points_in_boxes(points, box).count() == 20_000


def test_maps_may_ride_along(spark):
    one = shapes(spark, [(1, RING)]).withColumn("props", F.create_map(F.lit("a"), F.lit("b")))
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.0, 4.0)], "point_id long, x double, y double")
    assert [(p["point_id"], p["props"]) for p in geometry.points_in_polygons(points, one).collect()] == [(1, {"a": "b"})]


# --- Fewest tiles.


def test_two_hundred_tiles_in_a_second():
    r = random.Random(1)
    # Tiles of 12 on a grid of 10: needed places lie in the laps of two to four tiles.
    at = [(i, j) for i in range(20) for j in range(10)]
    places = [(r.uniform(0, 202), r.uniform(0, 102)) for _ in range(1500)]
    sets = [(f"t{i:02d}{j:02d}", {k for k, (x, y) in enumerate(places) if 10 * i <= x <= 10 * i + 12 and 10 * j <= y <= 10 * j + 12}) for i, j in at]
    began = time.perf_counter()
    got = geometry.minimal_cover_of(sets, set(range(len(places))))
    assert time.perf_counter() - began < 1 and set().union(*(s for n, s in sets if n in got)) == set(range(len(places)))
    # Only laps of a smaller grid: no tile is needed by itself.
    laps = [(n, {k for k in s if places[k][0] % 10 < 2 or places[k][1] % 10 < 2}) for (n, s), (i, j) in zip(sets, at) if i < 6 and j < 5]
    began = time.perf_counter()
    few = geometry.minimal_cover_of(laps, set().union(*(s for _, s in laps)))
    assert time.perf_counter() - began < 5 and 10 < len(few) < 30


def test_first_of_the_fewest_in_order():
    r = random.Random(2)
    for trial in range(300):
        n = r.randint(1, 9)
        sets = [(f"s{i}", {k for k in range(r.randint(1, 12)) if r.random() < 0.4}) for i in range(n)]
        need = set().union(*(s for _, s in sets))
        want = next(list(c) for k in range(n + 1) for c in itertools.combinations(sets, k) if need <= set().union(*(s for _, s in c)))
        assert geometry.minimal_cover_of(sets, need) == [name for name, _ in want], trial
    with pytest.raises(ValueError):
        geometry.minimal_cover_of([("a", {1})], {1, 2})


# --- Resampling and projection.

KIND = "raster_id string, a double, b double, c double, d double, e double, f double, height long, width long, crs string"


def test_average_to_a_finer_grid_has_no_holes(spark):
    px = spark.createDataFrame([("0", 0, 1, r, c, float(3 * c)) for r in range(4) for c in range(4)], "raster_id string, source_ord int, band int, row long, col long, value double")
    meta = spark.createDataFrame([("0", 1.0, 0.0, 0.0, 0.0, -1.0, 4.0, 4, 4, "EPSG:5070")], KIND)
    on = lambda size, n: {"a": size, "c": 0.0, "e": -size, "f": 4.0, "height": n, "width": n, "crs": "EPSG:5070"}
    fine = raster.reproject(px, meta, on(0.5, 8), "average").collect()
    assert len(fine) == 64 and all(x["value"] == 3 * (x["col"] // 2) for x in fine)
    some = {x["col"]: x["value"] for x in raster.reproject(px, meta, on(1.5, 3), "average").collect()}
    assert some == pytest.approx({0: (0 + 3 * 0.5) / 1.5, 1: (3 * 0.5 + 6) / 1.5, 2: 9.0})
    whole = {x["col"]: x["value"] for x in raster.reproject(px, meta, on(1.5, 3), "sum").filter("row = 0").collect()}
    assert whole == pytest.approx({0: (0 + 3 * 0.5) * 1.5, 1: (3 * 0.5 + 6) * 1.5, 2: 9 * 1.5})


def test_interpolated_places_are_within_the_tolerance(spark):
    meta = spark.createDataFrame([("0", 0.0005, 0.0, -99.5, 0.0, -0.0005, 40.0, 1200, 1200, "EPSG:4326"), ("1", 30.0, 0.0, 480000.0, 0.0, -30.0, 4420000.0, 900, 900, "EPSG:32615")], KIND)
    target = {"a": 200.0, "c": -330000.0, "e": -200.0, "f": 1910000.0, "height": 500, "width": 500, "crs": "EPSG:5070"}
    near = raster.source_places(meta, target)
    exact = near.join(meta, "raster_id").withColumns({"x": target["c"] + (F.col("col") + 0.5) * target["a"], "y": target["f"] + (F.col("row") + 0.5) * target["e"]})
    exact = crs.moved_each(exact, ["EPSG:4326", "EPSG:32615"], "crs", "EPSG:5070", back=True)
    off = exact.select("raster_id", F.greatest(F.abs((F.col("x") - F.col("c")) / F.col("a") - F.col("sx")), F.abs((F.col("y") - F.col("f")) / F.col("e") - F.col("sy"))).alias("off"))
    for r in off.groupBy("raster_id").agg(F.max("off").alias("off"), F.count("*").alias("n")).collect():
        assert r["n"] > 1000 and r["off"] < raster.TOLERANCE
    boxes = raster.extents_in(meta, "EPSG:5070").withColumns({"r0": F.lit(0).cast("long"), "r1": F.lit(499).cast("long"), "c0": F.lit(0).cast("long"), "c1": F.lit(499).cast("long")})
    blocks = raster._blocks(boxes, ["EPSG:4326", "EPSG:32615"], target, raster.TOLERANCE)
    assert blocks.count() < 500 * 500 / 16
    assert raster.source_places(meta, target, tolerance=1e-4).count() == near.count()


def test_average_across_systems_keeps_the_mean(spark):
    r = np.random.RandomState(0)
    values = 100 + np.cumsum(np.cumsum(r.randn(60, 60), 0), 1) / 10
    px = spark.createDataFrame([("0", 0, 1, i, j, float(values[i, j])) for i in range(60) for j in range(60)], "raster_id string, source_ord int, band int, row long, col long, value double")
    meta = spark.createDataFrame([("0", 0.01, 0.0, -99.3, 0.0, -0.01, 40.3, 60, 60, "EPSG:4326")], KIND)
    target = raster.target_grid(meta, "EPSG:5070")
    got = raster.reproject(px, meta, target, "average").filter("value is not null")
    low, high, mean, n = got.agg(F.min("value"), F.max("value"), F.avg("value"), F.count("*")).first()
    assert values.min() <= low and high <= values.max() and abs(mean - values.mean()) < 0.02 * np.ptp(values) and n > 2500
    flat = raster.reproject(px.withColumn("value", F.lit(7.0)), meta, target, "average").filter("value is not null")
    assert flat.agg(F.min("value"), F.max("value")).first() == (pytest.approx(7.0), pytest.approx(7.0))
