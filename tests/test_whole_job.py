
import random

import duckdb
import pytest

import __spark_entry__ as entry
from terravane import queries as core
from terravane.operators import geometry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("nation", "customer", "part", "lineitem", "supplier"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["region_intersects", "region_missing"])
def test_regions_beyond_the_smallest_tables(spark, con, name):
    got = sorted(tuple(r) for r in entry.queries()[name](spark, SF).collect())
    assert got == sorted(con.sql(entry.oracle_sql()[name]).fetchall())
    if name == "region_missing":
        assert len(got) == 1048


def test_boxes_of_all_sizes_meet_on_cells(spark):
    r = random.Random(4)

    def box():
        x, y, w, h = r.uniform(-50, 50), r.uniform(-50, 50), r.choice((0, 1e-3, 0.5, 8)) * r.random(), r.choice((0, 1e-3, 0.5, 8)) * r.random()
        return x, y, x + w, y + h

    a, b = [box() for _ in range(300)], [box() for _ in range(300)]
    a += [a[0], (None, 0.0, 1.0, 1.0), (100.0, 100.0, 101.0, 101.0), (900.0, 0.0, 1e7, 1.0)]
    b += [(101.0, 101.0, 102.0, 102.0), (1e6, -1e6, 3e6, 1e6), (0.0, None, 1.0, 1.0)]
    meets = lambda p, q: None not in p + q and p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1]
    at = "id long, minx double, miny double, maxx double, maxy double"
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], at)
    right = spark.createDataFrame([(i, *q) for i, q in enumerate(b)], at)
    want = {i for i, p in enumerate(a) if any(meets(p, q) for q in b)}
    assert 20 < len(want) < 290
    hit, free = geometry.regions_meeting(left, right), geometry.boxes_without_region(left, right)
    assert sorted(x["id"] for x in hit.collect()) == sorted(want) and sorted(x["id"] for x in free.collect()) == sorted(set(range(len(a))) - want)
    assert geometry.boxes_without_region(left, right.limit(0)).count() == len(a) and geometry.regions_meeting(left, right.limit(0)).count() == 0
    assert "NestedLoop" not in free._jdf.queryExecution().toString() and "NestedLoop" not in hit._jdf.queryExecution().toString()


def test_grid_alignment_of_every_part(spark, con, monkeypatch):
    seen = []
    monkeypatch.setattr(core.grid, "grids_align", lambda m, real=core.grid.grids_align: (seen.append(m.count()), real(m))[1])
    got = entry.queries()["pixel_grid_alignment"](spark, SF).collect()
    assert [tuple(x) for x in got] == con.sql(entry.oracle_sql()["pixel_grid_alignment"]).fetchall() and seen == [2000]


@pytest.mark.parametrize("name", ["stack_bands", "sample_points_multiband"])
def test_every_band(spark, con, name):
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    got = [tuple(x) for x in df.select(*want.columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
    bands = {x[1] for x in got} - {None} if "point" in name else {k for x in got for k, v in enumerate(x[2:], 2) if v is not None}
    assert bands == set(range(2, 9))


def test_minimal_cover_against_brute_force():
    r = random.Random(8)
    for _ in range(200):
        span = lambda n: sorted(r.sample(range(n + 1), 2))
        tiles = [(f"t{i}", (x0, y0, x1, y1)) for i in range(6) for (x0, x1), (y0, y1) in [(span(6), span(6))]]
        boxes = [(x0, y0, x1, y1) for _ in range(2) for (x0, x1), (y0, y1) in [(span(6), span(6))]]
        cells = lambda b: {(x, y) for x in range(b[0], b[2]) for y in range(b[1], b[3])}
        need = set().union(*map(cells, boxes))
        sets = [[t for i, t in enumerate(tiles) if m >> i & 1] for m in range(1, 64)]
        least = min((len(p) for p in sets if need <= set().union(*(cells(t[1]) for t in p))), default=None)
        if least is None:
            with pytest.raises(ValueError):
                geometry.minimal_cover(tiles, boxes)
        else:
            got = geometry.minimal_cover(tiles, boxes)
            assert len(got) == least and need <= set().union(*(cells(b) for n, b in tiles if n in got))
