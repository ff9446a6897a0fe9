"""Work that must not grow faster than the tables: rows of a small file over several tasks, pairs without shuffles, unions without depth."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terravane.operators import geometry, overlay

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["clip_to_rectangle", "wkt_part_bounds"])
def test_rows_of_one_file_go_to_several_tasks(spark, name):
    assert entry.queries()[name](spark, SF).rdd.getNumPartitions() >= 4


def test_a_ring_is_cut_once(spark):
    box = geometry.boxes_as_polygons(spark.range(3).select(F.col("id").alias("geom_id"), (F.col("id") * 4.0).alias("minx"), F.lit(0.0).alias("miny"), (F.col("id") * 4.0 + 3).alias("maxx"), F.lit(3.0).alias("maxy")))
    cut = geometry.clipped(box, 5.0, 1.0, 9.0, 9.0).filter(geometry.area(F.col("rings")) > 0)
    assert plan(cut).count("aggregate(array(") <= 1
    assert {r[0]: r[1] for r in cut.select("geom_id", geometry.area(F.col("rings"))).collect()} == {1: 4.0, 2: 2.0}


def stars(spark, n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = r.uniform(0, 9), r.uniform(0, 9)
        at = [(x + r.uniform(-2, 2), y + r.uniform(-2, 2)) for _ in range(5)]
        rows.append((i, [[*at, at[0]]]))
    return geometry.polygons(spark, rows)


def test_pairs_of_few_points_are_not_shuffled_by_slab(spark):
    assert "Window" not in plan(overlay.clipped_to(stars(spark, 5, 1), stars(spark, 5, 2)))


def test_small_and_large_groups_agree(spark, monkeypatch):
    one, other = stars(spark, 12, 3), stars(spark, 9, 4)

    def all_of():
        return [
            {(r.geom_id, r.area_id): r.area for r in overlay.clipped_to(one, other).collect()}, {r.geom_id: r.area for r in overlay.without(one, other).collect()},
            {r.k: r.area for r in overlay.dissolved(one.withColumn("k", F.col("geom_id") % 2), "k").collect()},
        ]

    small = all_of()
    monkeypatch.setattr(overlay, "ROW_POINTS", 14)
    for a, b in zip(small, all_of()):
        assert len(a) and a == pytest.approx(b, rel=1e-9)


def test_work_of_a_deep_union_is_that_of_its_distinct_parts(spark, monkeypatch):
    # 900 different boxes that lie some fifty deep, three times each, and triangles among them.
    rings = [[(x / 8, y / 8), (x / 8 + 2, y / 8), (x / 8 + 2, y / 8 + 1.5), (x / 8, y / 8 + 1.5), (x / 8, y / 8)] for x, y in itertools.product(range(30), range(30))]
    rings += [[(x, 0.3), (x + 2.3, 0.3), (x, 6.1), (x, 0.3)] for x in (0.1, 1.3, 2.9)]
    rows = [(i, [ring]) for i, ring in enumerate(rings * 3)]
    each = geometry.polygons(spark, rows).withColumn("k", F.lit(1))
    long = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    cells = overlay._in_cells(each.withColumn("parts", F.array("rings")), "k")
    covered = cells.groupBy("cx", "cy").count().filter("count = 1").count()
    assert covered > 30 and cells.count() < len(rows)
    found = overlay.union_pieces(each, "k")
    got = found.agg(F.sum(overlay.piece_area())).first()[0], overlay.boundary(found, "k").agg(F.sum(long)).first()[0]
    once = geometry.polygons(spark, [(0, [[(0, 0), (5.625, 0), (5.625, 5.125), (0, 5.125), (0, 0)]]), *((i + 1, [ring]) for i, ring in enumerate(rings[900:]))]).withColumn("k", F.lit(1))
    found = overlay.union_pieces(once, "k")
    assert got == pytest.approx((found.agg(F.sum(overlay.piece_area())).first()[0], overlay.boundary(found, "k").agg(F.sum(long)).first()[0]), rel=1e-9)


def test_points_in_a_polygon_of_many_parts_count_once(spark, monkeypatch):
    ring = lambda x, y: [(x, y), (x + 1.5, y), (x + 1.5, y + 1.5), (x, y + 1.5), (x, y)]
    parts = [[[{"x": float(x), "y": float(y)} for x, y in ring(i, j)]] for i, j in itertools.product(range(9), range(9))]
    polygon = spark.createDataFrame([(1, parts)], f"geom_id long, parts {geometry.PARTS}")
    points = spark.createDataFrame([(i % 40, i % 40 * 0.3 + 0.05, i % 40 * 0.27 + 0.05) for i in range(80)], "id long, x double, y double")
    got = sorted(geometry.points_in_polygons(points, polygon).collect())
    assert [r.id for r in got] == [i for i in range(40) if i * 0.3 + 0.05 < 9.5 and i * 0.27 + 0.05 < 9.5 for _ in (0, 1)]
    # A cell of such a polygon carries the edges of the parts near it.
    seen, covering = [], geometry.covering

    def cells_of(polygons):
        cells, levels = covering(polygons)
        seen.append(cells.agg(F.max(F.size(F.flatten("edges")))).first()[0] or 0)
        return cells, levels

    monkeypatch.setattr(geometry, "covering", cells_of)
    geometry.points_in_polygons(points, polygon).count()
    assert max(seen) <= 4


def test_large_tables_are_not_shuffled_for_few_components(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30k")
    try:
        text = plan(entry.queries()["soil_survey"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning(chkey" not in text and "Exchange hashpartitioning(horizon_key#" in text
