"""Kernels over chunks against sums over each target cell's neighbours, and what they shuffle."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import raster

KIND = "raster_id string, a double, b double, c double, d double, e double, f double, height long, width long, crs string"
WEIGHTS = {
    "bilinear": (1, lambda t: max(0.0, 1 - t)),
    "cubic": (2, lambda t: 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0),
    "lanczos": (3, lambda t: 1.0 if t == 0 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2 if t < 3 else 0.0),
}


def rasters(spark, size, bands=1, system="EPSG:32614"):
    """A raster with missing cells, nulls and one cell twice, and its metadata."""
    cells = spark.range(size * size).select(F.lit("a").alias("raster_id"), F.lit(0).alias("source_ord"), F.explode(F.sequence(F.lit(1), F.lit(bands))).alias("band"), F.expr(f"id div {size}").alias("row"), (F.col("id") % size).alias("col"), F.col("id"))
    value = F.when(F.col("id") % 7 != 3, (F.col("id") * 37 % 101).cast("double") + F.col("band"))
    cells = cells.filter("id % 11 <> 5").withColumn("value", value)
    cells = cells.unionByName(cells.filter("id = 40")).drop("id")
    return cells, spark.createDataFrame([("a", 30.0, 0.0, 500000.0, 0.0, -30.0, 4600000.0, size, size, system)], KIND)


def expected(cells, places, method):
    reach, weight = WEIGHTS[method]
    held = {}
    for r in cells.filter("value is not null").collect():
        held.setdefault((r["band"], r["row"], r["col"]), []).append(r["value"])
    out = {}
    for p in places.collect():
        i, j = math.floor(p["sy"] - 0.5), math.floor(p["sx"] - 0.5)
        for band in {k[0] for k in held}:
            top, below, seen = 0.0, 0.0, 0
            for r in range(i + 1 - reach, i + reach + 1):
                for c in range(j + 1 - reach, j + reach + 1):
                    w = weight(abs(p["sy"] - r - 0.5)) * weight(abs(p["sx"] - c - 0.5))
                    for v in held.get((band, r, c), ()):
                        top, below, seen = top + w * v, below + w, seen + 1
            if seen:
                out[band, p["row"], p["col"]] = top / below if below else None
    return out


@pytest.mark.parametrize("method", WEIGHTS)
@pytest.mark.parametrize("target", [
    {"a": 47.0, "c": 499990.0, "e": -19.0, "f": 4600031.0, "height": 60, "width": 24, "crs": "EPSG:32614"},
    {"a": 0.0004, "c": -99.001, "e": -0.0003, "f": 41.5525, "height": 40, "width": 40, "crs": "EPSG:4326"},
])
def test_chunks_give_the_sums_over_neighbours(spark, monkeypatch, method, target):
    monkeypatch.setattr(raster, "KERNEL_CHUNK", 16)
    cells, meta = rasters(spark, 35, bands=2)
    got = {(r["band"], r["row"], r["col"]): r["value"] for r in raster.reproject(cells, meta, target, method).collect()}
    want = expected(cells, raster.source_places(meta, target), method)
    assert len(want) > 500 and got.keys() == want.keys()
    for k, v in want.items():
        # Kernels with negative weights can have sums near nothing, where only the quotient's order of size is known.
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-6), k


def test_several_rasters_and_orders_and_empty_pixels(spark):
    cells, meta = rasters(spark, 8)
    target = {"a": 60.0, "c": 500000.0, "e": -60.0, "f": 4600000.0, "height": 4, "width": 4, "crs": "EPSG:32614"}
    both = cells.unionByName(cells.withColumns({"raster_id": F.lit("b"), "source_ord": F.lit(1), "value": F.col("value") + 1}))
    metas = meta.unionByName(meta.withColumns({"raster_id": F.lit("b")}))
    rows = {(r["raster_id"], r["source_ord"], r["row"], r["col"]): r["value"] for r in raster.reproject(both, metas, target, "bilinear").collect()}
    assert len(rows) == 32 and all(rows["b", 1, r, c] == pytest.approx(rows["a", 0, r, c] + 1) for r in range(4) for c in range(4))
    assert raster.reproject(cells.limit(0), meta, target, "cubic").count() == 0


def shuffled(node):
    """Rows that the exchanges below a node of an executed plan have written."""
    own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
    below = node.children()
    return own + sum(shuffled(below.apply(i)) for i in range(below.length()))


def test_kernels_shuffle_less_than_twice_the_pixels(spark):
    cells, meta = rasters(spark, 300)
    target = {"a": 29.0, "c": 500000.0, "e": -29.0, "f": 4600000.0, "height": 310, "width": 310, "crs": "EPSG:32614"}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for method in ("cubic", "lanczos"):
            out = raster.reproject(cells, meta, target, method)
            assert len(out.collect()) > 90_000
            n = shuffled(out._jdf.queryExecution().executedPlan())
            assert cells.filter("value is not null").count() <= n < 2 * cells.count(), (method, n)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
