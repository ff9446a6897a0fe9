"""Raster algebra on pixel tables.

``pixels``: raster_id, source_ord, band, row, col, value (double, null where missing).
``meta``: raster_id, a, b, c, d, e, f, height, width, crs; one row for each raster.
"""

from __future__ import annotations

import functools
import inspect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import crs as projections
from ..functions.grid import align_bounds, grids_align
from . import geometry

CELL = ["band", "row", "col"]


def _ordered(pick: Callable[[Column, Column], Column]) -> Callable[[], Column]:
    # min_by over an order that is null for missing values skips them.
    return lambda: pick(F.col("value"), F.when(F.col("value").isNotNull(), F.col("source_ord")))


RULES: dict[str, Callable[[], Column]] = {
    "first": _ordered(F.min_by),
    "last": _ordered(F.max_by),
    "min": lambda: F.min("value"),
    "max": lambda: F.max("value"),
    "sum": lambda: F.sum("value"),
    "count": lambda: F.count("value"),
    "mean": lambda: F.avg("value"),
    "variance": lambda: F.var_pop("value"),
    "stddev": lambda: F.stddev_pop("value"),
}


def without_nan(pixels: DataFrame) -> DataFrame:
    """NaN and null are one missing value (Q17)."""
    return pixels.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


#: Cells to a side of the chunks in which user-given rules see pixels.
FOLD_CHUNK, STACK_CHUNK = 512, 64
Rule = Callable[..., object]


def merge(pixels: DataFrame, method: str | Rule = "first", keys: list[str] | None = None) -> DataFrame:
    """Mosaic of co-registered sources by a rule over the valid values of each cell.

    A callable works on arrays, a chunk of cells at a time.  With four parameters (merged, new, merged_mask, new_mask) it is called for each
    source in order and changes ``merged`` in place; masks are true where a value is missing, and cells left NaN are missing.
    With one parameter it gets all sources of a chunk as (sources, cells), NaN where missing, and returns a value for each cell.
    """
    if isinstance(method, str):
        if method not in RULES:
            raise ValueError(f"unknown merge method {method}")
        return pixels.groupBy(*(keys or CELL)).agg(RULES[method]().alias("value"))
    if keys:
        raise ValueError("callables merge whole rasters")
    return _merged_by(pixels, method)


def _merged_by(pixels: DataFrame, rule: Rule) -> DataFrame:
    """Cells come sorted by chunk and source, so a task holds one chunk: two arrays for a fold, or its sources for a stack."""
    fold = len(inspect.signature(rule).parameters) == 4
    side = FOLD_CHUNK if fold else STACK_CHUNK

    def finish(key: tuple, merged: np.ndarray, stack: list[np.ndarray], seen: np.ndarray) -> pd.DataFrame:
        value = merged if fold else np.asarray(rule(np.stack(stack)), float)
        at = np.flatnonzero(seen)
        band, up, left = key
        return pd.DataFrame({"band": band, "row": up * side + at // side, "col": left * side + at % side, "value": value[at]})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, source, merged, new, seen, stack = None, None, None, None, None, []

        def close_source() -> None:
            if fold:
                gone = np.isnan(merged)
                rule(merged, new, gone, np.isnan(new))
            else:
                stack.append(new)

        for f in frames:
            starts = np.flatnonzero((f[["band", "up", "left", "source_ord"]].diff().fillna(1) != 0).any(axis=1).to_numpy())
            for i, j in zip(starts, [*starts[1:], len(f)]):
                part = f.iloc[i:j]
                k, src = tuple(part.iloc[0][["band", "up", "left"]].astype(int)), part["source_ord"].iloc[0]
                if source is not None and (k, src) != (key, source):
                    close_source()
                    source = None
                if k != key:
                    if key is not None:
                        yield finish(key, merged, stack, seen)
                    key, merged, seen, stack = k, np.full(side * side, np.nan), np.zeros(side * side, bool), []
                if source is None:
                    source, new = src, np.full(side * side, np.nan)
                at = (part["row"].to_numpy() - k[1] * side) * side + part["col"].to_numpy() - k[2] * side
                new[at] = part["value"].to_numpy(float)
                seen[at] = True
        if key is not None:
            close_source()
            yield finish(key, merged, stack, seen)

    chunk = {"up": F.floor(F.col("row") / side).cast("long"), "left": F.floor(F.col("col") / side).cast("long")}
    rows = pixels.select("band", "source_ord", "row", "col", F.col("value").cast("double").alias("value")).withColumns(chunk)
    rows = rows.repartition("band", "up", "left").sortWithinPartitions("band", "up", "left", "source_ord")
    out = rows.mapInPandas(work, "band int, row long, col long, value double")
    return without_nan(out)


def merge_flagged(pixels: DataFrame) -> DataFrame:
    """First valid value, and whether a later source disagrees with it."""
    return pixels.groupBy(*CELL).agg(RULES["first"]().alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def merge_variance(pixels: DataFrame, mean: DataFrame) -> DataFrame:
    """Mean squared deviation of the valid values from a given mean raster."""
    m = mean.select(*CELL, F.col("value").alias("m"))
    d = F.col("value") - F.col("m")
    return pixels.join(m, CELL).groupBy(*CELL).agg(F.avg(d * d).alias("value"))


def source_order(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """``meta`` with the source_ord of each raster; the pixels are read for it only where ``meta`` lacks it."""
    if "source_ord" in meta.columns:
        return meta
    return meta.join(pixels.groupBy("raster_id").agg(F.min("source_ord").alias("source_ord")), "raster_id", "left")


def base_grid(meta: DataFrame) -> DataFrame:
    """One row (a0, c0, e0, f0, crs0) with the grid of the first source."""
    return meta.agg(*(F.min_by(c, F.struct("source_ord", "raster_id")).alias(f"{c}0") for c in ("a", "c", "e", "f", "crs")))


def rebased(pixels: DataFrame, meta: DataFrame, allow_resampling: bool = False) -> DataFrame:
    """Rows and columns on the grid of the first source (R1, R9); other grids raise unless resampling is allowed.

    The metadata table has a row for each raster, and is small beside its pixels.
    """
    if not allow_resampling and not grids_align(meta).first()["aligned"]:
        raise ValueError("rasters do not share a pixel grid")
    shift = meta.select("raster_id", "a", "c", "e", "f").crossJoin(F.broadcast(base_grid(source_order(pixels, meta)))).select(  # one row
        "raster_id", (F.col("a") / F.col("a0")).alias("sx"), (F.col("e") / F.col("e0")).alias("sy"),
        ((F.col("c") - F.col("c0")) / F.col("a0")).alias("dx"), ((F.col("f") - F.col("f0")) / F.col("e0")).alias("dy"),
    )
    centre = lambda k, s, d: F.floor((F.col(k) + 0.5) * F.col(s) + F.col(d) + 1e-6).cast("long")
    return pixels.join(shift, "raster_id").withColumns({"row": centre("row", "sy", "dy"), "col": centre("col", "sx", "dx")}).drop("sx", "sy", "dx", "dy")


def merged_within(pixels: DataFrame, meta: DataFrame, bounds: tuple[float, float, float, float], method: str | Rule = "first", allow_resampling: bool = False) -> tuple[DataFrame, DataFrame]:
    """Mosaic within bounds (minx, miny, maxx, maxy), widened to the first source's pixels (R1, P2), and its metadata.

    Pixels outside are filtered before they meet, and rasters outside are not read.
    """
    at = dict(zip(("minx", "miny", "maxx", "maxy"), (F.lit(float(v)) for v in bounds)))
    base = base_grid(source_order(pixels, meta))
    t = {k: F.col(f"{k}0") for k in "acef"}
    box = align_bounds(at, t)
    window = base.select("*", *(v.alias(k) for k, v in box.items())).select(
        F.lit("merged").alias("raster_id"), t["a"].alias("a"), F.lit(0.0).alias("b"), F.col("minx").alias("c"), F.lit(0.0).alias("d"), t["e"].alias("e"), F.col("maxy").alias("f"),
        F.round((F.col("miny") - F.col("maxy")) / t["e"]).cast("long").alias("height"), F.round((F.col("maxx") - F.col("minx")) / t["a"]).cast("long").alias("width"), F.col("crs0").alias("crs"),
        F.round((F.col("maxy") - t["f"]) / t["e"]).cast("long").alias("row0"), F.round((F.col("minx") - t["c"]) / t["a"]).cast("long").alias("col0"),
    )
    x1, y1 = F.col("c") + F.col("a") * F.col("width"), F.col("f") + F.col("e") * F.col("height")
    near = meta.filter((F.col("c") < bounds[2]) & (x1 > bounds[0]) & (y1 < bounds[3]) & (F.col("f") > bounds[1]))
    cells = rebased(pixels.join(near.select("raster_id"), "raster_id", "left_semi"), meta, allow_resampling)
    inside = cells.crossJoin(F.broadcast(window.select("height", "width", "row0", "col0")))  # one row
    inside = inside.withColumns({"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")})
    inside = inside.filter((F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width")))
    return merge(inside.drop("height", "width", "row0", "col0"), method), window.drop("row0", "col0")


def stack(pixels: DataFrame) -> DataFrame:
    """Each source a band, in source order."""
    return pixels.withColumn("band", F.col("source_ord") + 1)


def within(pixels: DataFrame, first_row: int, first_col: int, height: int, width: int, pad: int = 0) -> DataFrame:
    """Window of rows and columns, with a margin."""
    return pixels.filter(F.col("row").between(first_row - pad, first_row + height + pad - 1) & F.col("col").between(first_col - pad, first_col + width + pad - 1))


def extents(meta: DataFrame) -> DataFrame:
    """``meta`` with minx, miny, maxx, maxy."""
    x, y = (F.col("c"), F.col("c") + F.col("a") * F.col("width")), (F.col("f"), F.col("f") + F.col("e") * F.col("height"))
    return meta.withColumns({"minx": F.least(*x), "maxx": F.greatest(*x), "miny": F.least(*y), "maxy": F.greatest(*y)})


def covered_spans(meta: DataFrame, polygons: DataFrame, all_touched: bool = False) -> DataFrame:
    """(raster_id, row, spans): inclusive column ranges of each raster row that the polygons cover; every row once.

    Edges are dealt to the raster rows that they enter, one row for each crossing; pixels are not read.
    """
    own = ["raster_id", "a", "c", "e", "f", "height", "width"]
    pairs = geometry.box_pairs(extents(meta.select(*own)), geometry.whole(polygons).select("parts", *geometry._BOUNDS).withColumn("p", F.monotonically_increasing_id()))
    each = pairs.select("l.*", F.col("r.p").alias("p"), F.posexplode("r.parts").alias("k", "rings")).select(*own, F.struct("p", "k").alias("part"), F.explode(geometry.edges(F.col("rings"))).alias("edge"))
    each = each.select("raster_id", "width", "part", F.col("edge.a").alias("a"), F.col("edge.b").alias("b"), F.col("c").alias("gx"), F.col("f").alias("gy"), F.col("a").alias("sx"), F.col("e").alias("sy"), F.lit(0).cast("long").alias("r0"), (F.col("height") - 1).cast("long").alias("r1"))
    rows = geometry.rows_of_edges(each, ["raster_id", "width"])
    spans = geometry.centre_spans(F.col("xs"))
    if all_touched:
        spans = F.concat(spans, F.col("touched"))
    spans = F.transform(spans, lambda s: F.struct(F.greatest(s["lo"], F.lit(0).cast("long")).alias("lo"), F.least(s["hi"], F.col("width").cast("long") - 1).alias("hi")))
    rows = rows.select("raster_id", "row", F.array_distinct(F.filter(spans, lambda s: s["lo"] <= s["hi"])).alias("spans")).filter(F.size("spans") > 0)
    return rows.groupBy("raster_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def mask(pixels: DataFrame, meta: DataFrame, polygons: DataFrame, all_touched: bool = False, crop: bool = False) -> DataFrame:
    """Values outside all polygons become null, or with ``crop`` cells outside their common extent go.

    A cell is inside where its centre is, or with ``all_touched`` where the cell meets a polygon.  Pixels meet the covered column
    ranges of their row, so they are read once, and stay where they are if the ranges are small enough for a broadcast.
    """
    spans = covered_spans(meta, polygons, all_touched)
    here = F.exists("spans", lambda s: (F.col("col") >= s["lo"]) & (F.col("col") <= s["hi"]))
    out = pixels.join(spans, ["raster_id", "row"], "left").withColumn("value", F.when(F.coalesce(here, F.lit(False)), F.col("value"))).drop("spans")
    if crop:
        box = spans.groupBy("raster_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min(F.array_min("spans.lo")).alias("c0"), F.max(F.array_max("spans.hi")).alias("c1"))
        out = out.join(box, "raster_id").filter("row between r0 and r1 and col between c0 and c1").drop("r0", "r1", "c0", "c1")
    return out.select(*pixels.columns)


def cells_of(points: DataFrame, meta: DataFrame, wrap_negative: bool = False) -> DataFrame:
    """(point_id, raster_id, row, col) of the rasters of ``meta`` that hold each point (x, y): points meet extents on cells."""
    boxes = extents(meta.select("raster_id", "a", "c", "e", "f", "height", "width"))
    if wrap_negative:
        # Rows before the first count from the last.
        boxes = boxes.withColumns({"miny": F.least("miny", F.col("f") - F.col("e") * F.col("height")), "maxy": F.greatest("maxy", F.col("f") - F.col("e") * F.col("height"))})
    row = F.floor((F.col("l.y") - F.col("r.f")) / F.col("r.e")).cast("long")
    if wrap_negative:
        row = F.when(row < 0, row + F.col("r.height")).otherwise(row)
    hit = geometry.points_in_boxes(points.select("point_id", "x", "y"), boxes).select(F.col("l.point_id").alias("point_id"), F.col("r.raster_id").alias("raster_id"), row.alias("row"), F.floor((F.col("l.x") - F.col("r.c")) / F.col("r.a")).cast("long").alias("col"), "r.height", "r.width")
    return hit.filter("row between 0 and height - 1 and col between 0 and width - 1").drop("height", "width")


def sample(points: DataFrame, pixels: DataFrame, meta: DataFrame, wrap_negative: bool = False) -> DataFrame:
    """(point_id, raster_id, row, col, band, value) of each raster that holds a point (x, y); one row of nulls for a point in none."""
    at = points.select("point_id").join(cells_of(points, meta, wrap_negative), "point_id", "left")
    return at.join(pixels.select("raster_id", "band", "row", "col", "value"), ["raster_id", "row", "col"], "left").select("point_id", "raster_id", "row", "col", "band", "value")


def upsampled(pixels: DataFrame, times: int = 2) -> DataFrame:
    """Every cell as times x times cells."""
    step = F.sequence(F.lit(0), F.lit(times - 1))
    wide = pixels.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
    return wide.withColumns({"row": F.col("row") * times + F.col("_i"), "col": F.col("col") * times + F.col("_j")}).drop("_i", "_j")


#: Resampling by aggregation over the source cells that a target cell overlaps, ``w`` being the share of the source cell.
AREA: dict[str, Callable[[], Column]] = {
    "average": lambda: F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum(F.when(F.col("value").isNotNull(), F.col("w")))),
    "max": lambda: F.max("value"),
    "min": lambda: F.min("value"),
    "sum": lambda: F.sum(F.col("w") * F.col("value")),
    "rms": lambda: F.sqrt(F.try_divide(F.sum(F.col("w") * F.col("value") * F.col("value")), F.sum(F.when(F.col("value").isNotNull(), F.col("w"))))),
}
#: The smallest value that, with the smaller ones, has this part of the shares.
QUANTILES = {"med": 0.5, "q1": 0.25, "q3": 0.75}
#: Shares below this come from rounding.
LEAST_SHARE = 1e-9


def _cubic(t: np.ndarray) -> np.ndarray:
    u = np.abs(t)
    return np.where(u <= 1, 1.5 * u * u * u - 2.5 * u * u + 1, np.where(u < 2, -0.5 * u * u * u + 2.5 * u * u - 4 * u + 2, 0.0))


def _spline(t: np.ndarray) -> np.ndarray:
    u = np.abs(t)
    return np.where(u <= 1, 2 / 3 - u * u + u * u * u / 2, np.where(u < 2, (2 - u) * (2 - u) * (2 - u) / 6, 0.0))


#: Resampling by weights of neighbours: reach in cells and weights of distances in cells.
KERNELS: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray]]] = {
    "bilinear": (1, lambda t: np.maximum(0.0, 1 - np.abs(t))),
    "cubic": (2, _cubic),
    "cubic_spline": (2, _spline),
    "lanczos": (3, lambda t: np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)),
    # Halves at a distance of one cell: 1 2 1 on whole cells.
    "gauss": (2, lambda t: np.where(np.abs(t) < 2, np.exp2(-t * t), 0.0)),
}
METHODS = ("nearest", *KERNELS, *AREA, *QUANTILES, "mode")


#: Points on each side of a raster by which its extent in another system is found.
SIDE_POINTS = 17
_GRID = ("a", "c", "e", "f", "crs")


def extents_in(meta: DataFrame, system: str) -> DataFrame:
    """``meta`` with the extents of its rasters in another reference system, by points along their sides."""
    codes = sorted(r[0] for r in meta.select("crs").distinct().collect())
    ends = extents(meta)
    share = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SIDE_POINTS - 1)), lambda i: i / float(SIDE_POINTS - 1)))
    along = ends.withColumn("_t", share).withColumn("_side", F.explode(F.sequence(F.lit(0), F.lit(3))))
    on = lambda lo, hi, fixed: F.when(F.col("_side") == fixed, F.col(lo)).when(F.col("_side") == fixed + 1, F.col(hi)).otherwise(F.col(lo) + F.col("_t") * (F.col(hi) - F.col(lo)))
    along = projections.moved_each(along.select("raster_id", "crs", on("minx", "maxx", 0).alias("x"), on("miny", "maxy", 2).alias("y")), codes, "crs", system)
    box = along.groupBy("raster_id").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    return meta.join(box, "raster_id")


def target_grid(meta: DataFrame, system: str, align_to: dict | None = None) -> dict:
    """The grid in ``system`` that holds all rasters: on the cells of ``align_to`` (a, c, e, f), or of the first raster's size.

    Without ``align_to`` cells are square, and the first raster's diagonal has as many of them as before.
    """
    boxes = extents_in(meta, system)
    order = F.struct("source_ord", "raster_id") if "source_ord" in meta.columns else F.col("raster_id")
    diagonal = F.sqrt(F.pow(F.col("maxx") - F.col("minx"), 2) + F.pow(F.col("maxy") - F.col("miny"), 2)) / F.sqrt(F.pow(F.col("height").cast("double"), 2) + F.pow(F.col("width").cast("double"), 2))
    r = boxes.agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), F.max("maxx").alias("x1"), F.max("maxy").alias("y1"), *(F.min_by(v, order).alias(k) for k, v in (("size", diagonal), ("x", F.col("minx")), ("y", F.col("maxy"))))).first()
    if r["x0"] is None:
        raise ValueError("no rasters")
    a, e = (align_to["a"], align_to["e"]) if align_to else (r["size"], -r["size"])
    ox, oy = (align_to["c"], align_to["f"]) if align_to else (r["x"], r["y"])
    # Whole cells from the grid's origin; a corner that is a cell's border to within rounding takes no cell more.
    col0, row0 = math.floor((r["x0"] - ox) / a + 1e-9), math.floor((r["y1"] - oy) / e + 1e-9)
    return {"a": a, "c": ox + col0 * a, "e": e, "f": oy + row0 * e, "width": math.ceil((r["x1"] - ox) / a - 1e-9) - col0, "height": math.ceil((r["y0"] - oy) / e - 1e-9) - row0, "crs": system}


#: Target cells to a side of a block in which places are interpolated before refinement, and the error allowed, in source cells.
BLOCK, TOLERANCE = 64, 0.125


def reproject(pixels: DataFrame, meta: DataFrame, target: dict, method: str = "nearest", tolerance: float = TOLERANCE) -> DataFrame:
    """Pixels of every raster on the target grid (a, c, e, f, height, width, crs).

    nearest and the kernels look up source cells around each target centre within a raster's extent; the others weigh the source
    cells that a target cell overlaps by their shares.  Places in another system are exact at the nodes of a grid that is as fine as ``tolerance``
    needs, and bilinear between them.  Rasters that have the target's grid are returned as they are (Q9 with equal crs).  Merged
    pixels, which carry no raster, belong to the only raster of ``meta``.
    """
    if method not in METHODS:
        raise ValueError(f"unsupported resampling {method}")
    if "raster_id" not in pixels.columns:
        ids = [r[0] for r in meta.select("raster_id").limit(2).collect()]
        if len(ids) != 1:
            raise ValueError("pixels without raster_id need the metadata of one raster")
        pixels = pixels.withColumns({"raster_id": F.lit(ids[0]), "source_ord": F.lit(0)})
    same = F.lit(True)
    for k in _GRID:
        same = same & F.col(k).eqNullSafe(F.lit(target[k]))
    odd = meta.filter(~same)
    if odd.isEmpty():
        return pixels
    out = _resampled(pixels, odd, target, method, tolerance)
    return out.unionByName(pixels.join(meta.filter(same).select("raster_id"), "raster_id", "left_semi").select(*out.columns))


def _blocks(boxes: DataFrame, codes: list[str], target: dict, tolerance: float) -> DataFrame:
    """(raster_id, r0, c0, n, p): blocks of n x n target cells, p being the source places (sx, sy) of their corners.

    The places at the middle and the sides' middles of blocks of ``BLOCK`` cells show the error of interpolation there.  It falls with
    the square of the size, so each block is cut as finely as it needs, with a factor of two to spare, and the nodes projected.
    """

    def placed(df: DataFrame, steps: list[tuple[float, float]]) -> DataFrame:
        own = [c for c in df.columns if c not in ("a", "c", "e", "f", "crs")]
        k = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(u).alias("u"), F.lit(v).alias("v")) for i, (u, v) in enumerate(steps))))
        at = df.withColumn("_k", k).withColumns({"x": target["c"] + (F.col("c0") + F.col("_k.v") * F.col("n")) * target["a"], "y": target["f"] + (F.col("r0") + F.col("_k.u") * F.col("n")) * target["e"]})
        at = projections.moved_each(at, codes, "crs", target["crs"], back=True)
        sx, sy = (F.col("x") - F.col("c")) / F.col("a"), (F.col("y") - F.col("f")) / F.col("e")
        point = F.struct(F.col("_k.k").alias("k"), sx.alias("sx"), sy.alias("sy"))
        # At most nine points a block.
        return at.groupBy(*own, "a", "c", "e", "f", "crs").agg(F.array_sort(F.collect_list(point)).alias("p"))

    first = lambda k: F.expr(f"explode(sequence({k}0 div {BLOCK} * {BLOCK}, {k}1, {BLOCK}L))")
    rough = boxes.withColumn("_r", first("r")).withColumn("_c", first("c")).select("raster_id", *_GRID, F.col("_r").alias("r0"), F.col("_c").alias("c0"), F.lit(BLOCK).alias("n"))
    rough = placed(rough, [(0, 0), (0, 1), (1, 0), (1, 1), (0.5, 0.5), (0, 0.5), (0.5, 0), (0.5, 1), (1, 0.5)])
    p = F.col("p")
    mean = lambda k, *at: sum(p[i][k] for i in at) / len(at)
    tests = {4: (0, 1, 2, 3), 5: (0, 1), 6: (0, 2), 7: (1, 3), 8: (2, 3)}
    error = F.greatest(*(F.abs(p[i][k] - mean(k, *at)) for i, at in tests.items() for k in ("sx", "sy")))
    most = BLOCK.bit_length() - 1
    cuts = F.lit(most) if tolerance <= 0 else F.least(F.lit(most), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(2 * error / tolerance, F.lit(1e-9))) / 2)))
    fine = rough.withColumn("n", F.pow(F.lit(2.0), most - cuts).cast("int")).drop("p")
    step = lambda k: F.explode(F.expr(f"sequence({k}0, {k}0 + {BLOCK} - n, cast(n as long))"))
    fine = fine.withColumn("_r", step("r")).withColumn("_c", step("c")).withColumns({"r0": F.col("_r"), "c0": F.col("_c")}).drop("_r", "_c")
    return placed(fine, [(0, 0), (0, 1), (1, 0), (1, 1)]).select("raster_id", "r0", "c0", "n", "p")


def _over(meta: DataFrame, target: dict) -> DataFrame:
    """Rasters with the rows r0 to r1 and columns c0 to c1 of the target's cells over them."""
    boxes = extents_in(meta.select("raster_id", *_GRID, "height", "width"), target["crs"])
    ends = lambda lo, hi, o, s, n: (F.greatest(F.lit(0), F.floor(F.least((F.col(lo) - target[o]) / target[s], (F.col(hi) - target[o]) / target[s]))).cast("long"), F.least(F.lit(n - 1), F.ceil(F.greatest((F.col(lo) - target[o]) / target[s], (F.col(hi) - target[o]) / target[s]))).cast("long"))
    r0, r1 = ends("miny", "maxy", "f", "e", target["height"])
    c0, c1 = ends("minx", "maxx", "c", "a", target["width"])
    return boxes.withColumns({"r0": r0, "r1": r1, "c0": c0, "c1": c1}).filter("r0 <= r1 and c0 <= c1")


def source_places(meta: DataFrame, target: dict, corners: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """(raster_id, row, col, sx, sy) of the target cells over each raster: where their centres lie in the raster, in its cells.

    With ``corners`` the box x0, x1, y0, y1 about the places of a cell's corners stands for the centre.
    """
    codes = sorted(r[0] for r in meta.select("crs").distinct().collect())
    boxes = _over(meta, target)
    out = []
    row, col = F.col("row"), F.col("col")

    def places(cells: DataFrame, at: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
        if not corners:
            sx, sy = at(row + 0.5, col + 0.5)
            return cells.select("raster_id", "row", "col", sx.alias("sx"), sy.alias("sy"))
        xs, ys = zip(*(at(row + i, col + j) for i in (0, 1) for j in (0, 1)))
        return cells.select("raster_id", "row", "col", F.least(*xs).alias("x0"), F.greatest(*xs).alias("x1"), F.least(*ys).alias("y0"), F.greatest(*ys).alias("y1"))

    if target["crs"] in codes:
        own = boxes.filter(F.col("crs") == target["crs"]).withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
        out.append(places(own, lambda r, c: ((target["c"] + c * target["a"] - F.col("c")) / F.col("a"), (target["f"] + r * target["e"] - F.col("f")) / F.col("e"))))
    others = [k for k in codes if k != target["crs"]]
    if others:
        blocks = _blocks(boxes.filter(F.col("crs") != target["crs"]), others, target, tolerance)
        inner = F.expr("sequence(0L, cast(n - 1 as long))")
        cells = blocks.withColumn("row", F.explode(inner)).withColumn("col", F.explode(inner)).withColumns({"row": F.col("row") + F.col("r0"), "col": F.col("col") + F.col("c0")})
        cells = cells.filter((row < target["height"]) & (col < target["width"]))

        def between(r: Column, c: Column) -> tuple[Column, Column]:
            u, v, p = (r - F.col("r0")) / F.col("n"), (c - F.col("c0")) / F.col("n"), F.col("p")
            return tuple((p[0][k] * (1 - v) + p[1][k] * v) * (1 - u) + (p[2][k] * (1 - v) + p[3][k] * v) * u for k in ("sx", "sy"))

        out.append(places(cells, between))
    return functools.reduce(DataFrame.unionByName, out)


def _covered(lo: Column, hi: Column) -> Column:
    """The whole cells that an interval enters."""
    return F.sequence(F.floor(lo + LEAST_SHARE).cast("long"), F.greatest(F.floor(lo + LEAST_SHARE), F.ceil(hi - LEAST_SHARE) - 1).cast("long"))


def _common(lo: Column, hi: Column, cell: Column) -> Column:
    return F.least(hi, cell + 1) - F.greatest(lo, cell)


def shares(pixels: DataFrame, meta: DataFrame, target: dict, tolerance: float = TOLERANCE) -> DataFrame:
    """(raster_id, source_ord, band, row, col, value, w): source cells under each target cell, w being the part of the source cell that it has.

    In the target's own system each source cell is dealt to the target cells that it overlaps, without a join.  In another system a
    target cell has the cells of the box about its corners' places, which are joined.
    """
    kept = ["raster_id", "source_ord", *CELL, "value", "w"]
    own, other = meta.filter(F.col("crs") == target["crs"]), meta.filter(F.col("crs") != target["crs"])
    at = pixels.join(own.select("raster_id", *_GRID), "raster_id")
    ends = lambda k, o, s: tuple((F.col(o) + (F.col(k) + i) * F.col(s) - target[o]) / target[s] for i in (0, 1))
    (x, x1), (y, y1) = ends("col", "c", "a"), ends("row", "f", "e")
    at = at.select("raster_id", "source_ord", "band", "value", *(f(v, w).alias(n) for n, f, v, w in (("x0", F.least, x, x1), ("x1", F.greatest, x, x1), ("y0", F.least, y, y1), ("y1", F.greatest, y, y1))))
    at = at.filter((F.col("x1") > 0) & (F.col("x0") < target["width"]) & (F.col("y1") > 0) & (F.col("y0") < target["height"]))
    at = at.withColumn("row", F.explode(_covered(F.col("y0"), F.col("y1")))).withColumn("col", F.explode(_covered(F.col("x0"), F.col("x1"))))
    part = _common(F.col("x0"), F.col("x1"), F.col("col")) * _common(F.col("y0"), F.col("y1"), F.col("row")) / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    at = at.withColumn("w", part).filter((F.col("w") > LEAST_SHARE) & F.col("row").between(0, target["height"] - 1) & F.col("col").between(0, target["width"] - 1)).select(*kept)
    if other.isEmpty():
        return at
    cells = source_places(other, target, corners=True, tolerance=tolerance)
    cells = cells.withColumn("sr", F.explode(_covered(F.col("y0"), F.col("y1")))).withColumn("sc", F.explode(_covered(F.col("x0"), F.col("x1"))))
    cells = cells.withColumn("w", _common(F.col("x0"), F.col("x1"), F.col("sc")) * _common(F.col("y0"), F.col("y1"), F.col("sr"))).filter(F.col("w") > LEAST_SHARE)
    source = pixels.select("raster_id", "source_ord", "band", F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    return at.unionByName(cells.join(source, ["raster_id", "sr", "sc"]).select(*kept))


#: Cells to a side of the chunks of source cells on which kernels work.
KERNEL_CHUNK = 512


def _weighed(pixels: DataFrame, meta: DataFrame, target: dict, method: str, tolerance: float) -> DataFrame:
    """Weighted means of the valid source cells about each target centre, a chunk of source cells at a time.

    Source cells are shuffled once, to the chunk that they lie in and to those neighbours whose kernels reach them (the halo).  Target
    cells are not shuffled: a chunk's task makes those whose neighbourhood begins in it, from the few blocks of cells that meet it.
    Chunks are smaller where the target is finer, so a task holds about ``KERNEL_CHUNK`` squared cells of each band on either side.
    Weights are added in the order of rows and columns, so results do not depend on the partitions.
    """
    reach, weight = KERNELS[method]
    boxes = _over(meta, target)
    finer = F.sqrt((F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1) / (F.col("height") * F.col("width")))
    found = boxes.agg(F.max(finer).alias("finer"), F.collect_set("crs").alias("codes")).first()
    # From about 30 times finer on, a task's target cells grow.
    side = max(16, int(KERNEL_CHUNK / max(1.0, found["finer"] or 1.0)))
    chunks = lambda k: F.explode(F.expr(f"sequence(cast(floor(({k} - {reach}) / {side}) as long), cast(floor(({k} + {reach - 1}) / {side}) as long))"))
    source = pixels.filter("value is not null").select("raster_id", "source_ord", "band", F.col("row").cast("long").alias("sr"), F.col("col").cast("long").alias("sc"), F.col("value").cast("double").alias("value"))
    source = source.withColumn("cr", chunks("sr")).withColumn("cc", chunks("sc"))

    last = lambda k: F.expr(f"({k} + {reach}) div {side}")
    own = boxes.filter(F.col("crs") == target["crs"]).withColumns({"place": F.array("a", "c", "e", "f"), "nr": F.col("r1") - F.col("r0") + 1, "nc": F.col("c1") - F.col("c0") + 1, "n": F.lit(0)})
    own = own.withColumn("cr", F.explode(F.sequence(F.lit(-1).cast("long"), last("height")))).withColumn("cc", F.explode(F.sequence(F.lit(-1).cast("long"), last("width"))))
    kept = ["raster_id", "cr", "cc", "r0", "c0", "nr", "nc", "n", "place"]
    blocks = own.select(*kept)
    others = sorted(k for k in found["codes"] if k != target["crs"])
    if others:
        made = _blocks(boxes.filter(F.col("crs") != target["crs"]), others, target, tolerance).join(boxes.select("raster_id", "height", "width"), "raster_id")
        made = made.withColumns({"nr": F.least(F.col("n"), target["height"] - F.col("r0")), "nc": F.least(F.col("n"), target["width"] - F.col("c0"))}).filter("nr > 0 and nc > 0")
        for at, k, size in (("cr", "sy", "height"), ("cc", "sx", "width")):
            ends = F.array(*(F.floor(F.floor(F.col("p")[m][k] - 0.5) / side).cast("long") for m in range(4)))
            made = made.withColumns({"_lo": F.greatest(F.array_min(ends), F.lit(-1)), "_hi": F.least(F.array_max(ends), last(size))}).filter("_lo <= _hi").withColumn(at, F.explode(F.sequence("_lo", "_hi")))
        blocks = blocks.unionByName(made.withColumn("place", F.flatten(F.transform("p", lambda p: F.array(p["sx"], p["sy"])))).select(*kept))

    def centres(block: dict, i0: int, j0: int) -> tuple[np.ndarray, ...]:
        """Rows, columns, and source places (sy, sx) of a block's cells whose neighbourhoods begin in the chunk at (i0, j0)."""
        place, rows, cols = block["place"], np.arange(block["r0"], block["r0"] + block["nr"]), np.arange(block["c0"], block["c0"] + block["nc"])
        r, c = rows + 0.5, cols + 0.5
        inside = lambda s, first: (np.floor(s - 0.5) >= first) & (np.floor(s - 0.5) < first + side)
        if len(place) == 4:
            a, x, e, y = place
            sy, sx = (target["f"] + r * target["e"] - y) / e, (target["c"] + c * target["a"] - x) / a
            on_r, on_c = inside(sy, i0), inside(sx, j0)
            shape = (int(on_r.sum()), int(on_c.sum()))
            return tuple(np.broadcast_to(v, shape).ravel() for v in (rows[on_r][:, None], cols[on_c][None, :], sy[on_r][:, None], sx[on_c][None, :]))
        u, v = ((r - block["r0"]) / block["n"])[:, None], ((c - block["c0"]) / block["n"])[None, :]
        sx, sy = ((place[k] * (1 - v) + place[k + 2] * v) * (1 - u) + (place[k + 4] * (1 - v) + place[k + 6] * v) * u for k in (0, 1))
        on = inside(sy, i0) & inside(sx, j0)
        return np.broadcast_to(rows[:, None], on.shape)[on], np.broadcast_to(cols[None, :], on.shape)[on], sy[on], sx[on]

    kinds = {f.name: f.dataType for f in pixels.schema}
    schema = T.StructType([T.StructField("raster_id", kinds["raster_id"]), T.StructField("source_ord", kinds["source_ord"]), T.StructField("band", kinds["band"]), T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("value", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def weigh(key: tuple, cells: pa.Table, blocks: pa.Table) -> pa.Table:
        if not cells.num_rows or not blocks.num_rows:
            return arrow.empty_table()
        i0, j0 = key[1].as_py() * side, key[2].as_py() * side
        row, col, sy, sx = (np.concatenate(v) for v in zip(*(centres(b, i0, j0) for b in blocks.to_pylist())))
        i, j = np.floor(sy - 0.5).astype(np.int64), np.floor(sx - 0.5).astype(np.int64)
        steps = range(1 - reach, reach + 1)
        wy, wx = ([weight(s - (k + d) - 0.5) for d in steps] for s, k in ((sy, i), (sx, j)))
        wide = side + 2 * reach - 1
        begin = (i - i0) * wide + j - j0
        out = []
        for (order, band), part in cells.select(["source_ord", "band", "sr", "sc", "value"]).to_pandas().groupby(["source_ord", "band"], dropna=False):
            at = ((part["sr"] - i0 + reach - 1) * wide + part["sc"] - j0 + reach - 1).to_numpy()
            total, held = np.bincount(at, part["value"], wide * wide), np.bincount(at, minlength=wide * wide)
            top, below, seen = np.zeros(len(row)), np.zeros(len(row)), np.zeros(len(row), np.int64)
            for m, across in enumerate(wy):
                for n, along in enumerate(wx):
                    near, w = begin + m * wide + n, across * along
                    top, below, seen = top + w * total[near], below + w * held[near], seen + held[near]
            on = seen > 0
            lost = below[on] == 0
            value = pa.array(top[on] / np.where(lost, 1.0, below[on]), mask=lost)
            fixed = [pa.array([v], from_pandas=True).cast(arrow.field(k).type) for k, v in (("source_ord", order), ("band", band))]
            same = [pa.repeat(v, int(on.sum())) for v in (key[0].cast(arrow.field(0).type), *(f[0] for f in fixed))]
            out.append(pa.Table.from_arrays([*same, pa.array(row[on], pa.int64()), pa.array(col[on], pa.int64()), value], schema=arrow))
        return pa.concat_tables(out)

    keys = ("raster_id", "cr", "cc")
    return source.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(weigh, schema)


def _resampled(pixels: DataFrame, meta: DataFrame, target: dict, method: str, tolerance: float) -> DataFrame:
    cell = ["raster_id", "source_ord", *CELL]
    if method in AREA:
        return shares(pixels, meta, target, tolerance).groupBy(*cell).agg(AREA[method]().alias("value"))
    if method in QUANTILES or method == "mode":
        each = shares(pixels, meta, target, tolerance).groupBy(*cell, "value").agg(F.sum("w").alias("w"))
        if method == "mode":
            # Of equal shares the smallest value.
            return each.groupBy(*cell).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.struct(F.round("w", 9), -F.col("value")))).alias("value"))
        valid = F.when(F.col("value").isNotNull(), F.col("w"))
        here = Window.partitionBy(*cell)
        each = each.withColumns({"below": F.sum(valid).over(here.orderBy(F.col("value").asc_nulls_last())), "all": F.sum(valid).over(here)})
        enough = F.col("below") >= (QUANTILES[method] - LEAST_SHARE) * F.col("all")
        return each.groupBy(*cell).agg(F.min(F.when(enough, F.col("value"))).alias("value"))
    if method in KERNELS:
        return _weighed(pixels, meta, target, method, tolerance)
    at = source_places(meta, target, tolerance=tolerance).withColumns({"sr": F.floor("sy").cast("long"), "sc": F.floor("sx").cast("long")})
    source = pixels.select("raster_id", "source_ord", "band", F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    return at.join(source, ["raster_id", "sr", "sc"]).select(*cell, "value")


def align(pixels: DataFrame, meta: DataFrame, to: DataFrame, method: str = "nearest") -> tuple[DataFrame, DataFrame]:
    """Pixels on the grid of another raster, whose metadata is the one row ``to``, and the metadata of that grid."""
    return reproject_and_merge(pixels, meta, None, method, None, to)


def reproject_and_merge(pixels: DataFrame, meta: DataFrame, system: str | None, method: str, rule: str | Rule | None = "first", to: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every raster on one grid of a reference system, then merged by a rule; pixels and metadata.

    The grid has the cells of ``to`` (one row of metadata) or else of the first raster, and covers all rasters, so each pixel is
    resampled once.  Without a rule rasters stay apart.
    """
    grid = to.select(*_GRID).first().asDict() if to is not None else None
    target = target_grid(meta, system or grid["crs"], grid if grid and grid["crs"] == (system or grid["crs"]) else None)
    out = reproject(pixels, meta, target, method)
    row = {"raster_id": "merged", **target, "b": 0.0, "d": 0.0}
    kind = "raster_id string, a double, b double, c double, d double, e double, f double, height long, width long, crs string"
    made = pixels.sparkSession.createDataFrame([tuple(row[k.split()[0]] for k in kind.split(", "))], kind)
    return (out if rule is None else merge(out, rule)), made


def align_and_merge(pixels: DataFrame, meta: DataFrame, to: DataFrame, method: str, rule: str | Rule = "first") -> tuple[DataFrame, DataFrame]:
    """Every raster on the grid of another one, then merged by a rule."""
    return reproject_and_merge(pixels, meta, None, method, rule, to)


def aligned_origin(own: Column, other: Column, size: Column) -> Column:
    """Origin moved by the smallest offset, at most half a cell, onto another grid."""
    off = F.pmod(other - own, F.abs(size))
    return own + off - F.when(off > F.abs(size) / 2, F.abs(size)).otherwise(0.0)


def algebra(left: DataFrame, right: DataFrame, op: Callable[[Column, Column], Column], how: str = "inner") -> DataFrame:
    """Cell by cell operation on co-registered rasters; null where either is."""
    r = right.select(*CELL, F.col("value").alias("other"))
    return left.join(r, CELL, how).select(*CELL, op(F.col("value"), F.col("other")).alias("value"))


def same_shape(metas: DataFrame, tolerance: float = 0.0) -> None:
    """Raise where rasters differ in size, or in origin or cell size by more than the tolerance."""
    r = metas.agg(F.count_distinct("height", "width").alias("n"), *((F.max(k) - F.min(k)).alias(k) for k in ("a", "c", "e", "f"))).first()
    if r["n"] > 1 or any((r[k] or 0) > tolerance for k in ("a", "c", "e", "f")):
        raise ValueError("rasters differ in grid")


def recode(pixels: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels with values replaced by table (value, id), and the codes that it lacks.

    A code's text that is no number is skipped.  The table's size decides whether it is broadcast.
    """
    known = table.select(F.col("value").cast("double").alias("value"), F.expr("cast(try_cast(id as double) as long)").alias("id")).filter("id is not null")
    out = pixels.join(known, "value", "left")
    lost = pixels.filter("value is not null").select("value").distinct().join(known, "value", "left_anti")
    return out.withColumn("value", F.col("id").cast("long")).drop("id"), lost


def value_counts(tables: DataFrame) -> DataFrame:
    """Sums of counts over archives (archive, value, count); none if an archive has no table."""
    return tables.groupBy("value").agg(F.sum("count").alias("count"))
