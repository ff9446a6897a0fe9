"""Geometry predicates as column expressions.

``polygons``: geom_id and ``rings``: array<array<struct<x, y>>>, closed, a point being inside by the even-odd rule; or ``parts``, an array
of such rings, a point being inside where it is inside any part, so that parts may overlap.  Joins meet on square cells first, of the size of
the larger of the two, so that a geometry of any size takes a few cells, and are refined exactly.
"""

from __future__ import annotations

import collections
import functools
import itertools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{_POINT}>>"
PARTS = f"array<{RINGS}>"
#: Parts of a polygon that are covered together.
MANY_PARTS = 64
#: Half of the swath that an orbit sees, with a margin, in metres (fixed values: 290 + 10 km).
SWATH_REACH = 150_000.0


def polygons(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """From (geom_id, [ring, ...]), a ring being a list of (x, y)."""
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, rings in rows], f"geom_id long, rings {RINGS}")


def edges(rings: Column) -> Column:
    """Edges (a, b) of all rings."""
    pairs = F.transform(rings, lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return F.flatten(pairs)


def bounds(rings: Column) -> dict[str, Column]:
    """Extent (G16)."""
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule by the crossings of a ray to the right."""
    return F.aggregate(edges(rings), F.lit(False), lambda odd, e: odd != _crosses(e, x, y))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    a, b = e["a"], e["b"]
    at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
    return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segment_meets_open_box(a: Column, b: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a segment has a point inside an open box."""
    apart = (F.greatest(a["x"], b["x"]) <= x0) | (F.least(a["x"], b["x"]) >= x1) | (F.greatest(a["y"], b["y"]) <= y0) | (F.least(a["y"], b["y"]) >= y1)
    s = [_side(a["x"], a["y"], b["x"], b["y"], x, y) for x, y in ((x0, y0), (x0, y1), (x1, y0), (x1, y1))]
    return ~apart & (F.least(*s) < 0) & (F.greatest(*s) > 0)


def whole(polygons: DataFrame) -> DataFrame:
    """``polygons`` with ``parts`` in the place of ``rings``, and their extent."""
    p = polygons if "parts" in polygons.columns else polygons.withColumn("parts", F.array("rings")).drop("rings")
    return p.withColumns(bounds(F.flatten("parts")))


def inside(parts: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside any part."""
    return F.exists(parts, lambda rings: contains(rings, x, y))


def box_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r) rows of the pairs whose extents (minx, miny, maxx, maxy) meet, each pair once: an equi-join on cells.

    A pair has one cell with the lower left corner of the common extent, and counts there only.  Levels of cells are
    powers of two; the distinct ones of either side, a few dozen numbers, are what the driver gets.
    """
    level = F.ceil(F.log2(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1e-9)))).cast("int")

    def keyed(t: DataFrame, name: str) -> DataFrame:
        box = F.struct(*(F.col(k).cast("double").alias(k) for k in _BOUNDS)).alias("_box")
        return t.dropna(subset=list(_BOUNDS)).select(F.struct(*t.columns).alias(name), box, level.alias("_level")).select(name, "_box.*", F.col("_level").alias("level"))

    a, b = keyed(left, "l"), keyed(right, "r")
    of_a, of_b = ([x[0] for x in t.select("level").distinct().collect()] for t in (a, b))
    at = ["level", "other", "cx", "cy"]
    a = _on_levels(a, of_b).select("l", *at, *(F.col(k).alias(f"a_{k}") for k in _BOUNDS))
    b = _on_levels(b, of_a).select("r", F.col("other").alias("level"), F.col("level").alias("other"), "cx", "cy", *(F.col(k).alias(f"b_{k}") for k in _BOUNDS))
    size = F.pow(F.lit(2.0), F.greatest("level", "other"))
    corner = lambda axis: F.floor(F.greatest(f"a_min{axis}", f"b_min{axis}") / size).cast("long")
    meets = (F.col("a_minx") <= F.col("b_maxx")) & (F.col("a_maxx") >= F.col("b_minx")) & (F.col("a_miny") <= F.col("b_maxy")) & (F.col("a_maxy") >= F.col("b_miny"))
    return a.join(b, at).filter(meets & (F.col("cx") == corner("x")) & (F.col("cy") == corner("y"))).select("l", "r")


#: Cells to a side of the grid that covers one extent, as a power of two, and cells of all extents of one size together.
COVER_DEPTH, COVER_CELLS = 4, 1 << 20


def _cover_level(boxes: DataFrame) -> tuple[DataFrame, list[int]]:
    """``boxes`` (minx, miny, maxx, maxy, ...) with ``level``, and the levels: cells of size 2^level cover each extent by a grid.

    The grid has up to 17 x 17 cells, fewer where very many extents have one size; so a huge extent spreads its rows over many keys, and
    small ones take few rows.  The driver gets how many extents there are of each size, a few dozen numbers.
    """
    size = F.ceil(F.log2(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1e-9)))).cast("int")
    held = {r[0]: r[1] for r in boxes.groupBy(size.alias("s")).count().collect() if r[0] is not None}
    depth = {k: max(0, min(COVER_DEPTH, int(math.log(COVER_CELLS / n, 4)))) for k, n in held.items()}
    level = F.coalesce(*(F.when(size == k, k - d) for k, d in depth.items())) if depth else F.lit(0)
    return boxes.dropna(subset=list(_BOUNDS)).withColumn("level", level.cast("int")), sorted({k - d for k, d in depth.items()})


def _keyed_points(points: DataFrame, levels: list[int]) -> DataFrame:
    """(row, level, cx, cy): every point (x, y, ...) in its cell of each level."""
    rows = points.filter("x is not null and y is not null").select(F.struct(*points.columns).alias("row"), F.explode(F.lit(levels).cast("array<int>")).alias("level"))
    cell = lambda k: F.floor(F.col(f"row.{k}") / F.pow(F.lit(2.0), "level")).cast("long")
    return rows.select("row", "level", cell("x").alias("cx"), cell("y").alias("cy"))


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(l, r) rows of the points (x, y, ...) and the closed boxes (minx, miny, maxx, maxy, ...) that hold them."""
    own, levels = _cover_level(boxes.select(F.struct(*boxes.columns).alias("r"), *_BOUNDS))
    size = F.pow(F.lit(2.0), "level")
    span = lambda k: F.explode(F.sequence(F.floor(F.col(f"min{k}") / size).cast("long"), F.floor(F.col(f"max{k}") / size).cast("long")))
    cells = own.withColumn("cx", span("x")).withColumn("cy", span("y"))
    hit = _keyed_points(points, levels).join(cells, ["level", "cx", "cy"])
    return hit.filter("row.x between minx and maxx and row.y between miny and maxy").select(F.col("row").alias("l"), "r")


def rows_of_edges(edges: DataFrame, ids: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """(ids, part, row, xs, touched, edges, carried) of each part and grid row that its edges enter; ids decide the carried columns.

    ``edges``: ids, part, a, b (points) and the grid gx, gy, sx, sy (corner and signed cell size), r0, r1 (rows wanted, null for all).  An edge
    is dealt to the rows that it enters.  xs: where edges cross the row's middle line, in order, in columns; touched: open column ranges that edges pass.
    """
    line = lambda v: (v - F.col("gy")) / F.col("sy")
    column = lambda v: (v - F.col("gx")) / F.col("sx")
    ya, yb = line(F.col("a.y")), line(F.col("b.y"))
    lo, hi = F.floor(F.least(ya, yb)).cast("long"), (F.ceil(F.greatest(ya, yb)) - 1).cast("long")
    lo, hi = F.greatest(lo, F.coalesce("r0", lo)), F.least(hi, F.coalesce("r1", hi))
    each = edges.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi").withColumn("row", F.explode(F.sequence("_lo", "_hi")))
    top, bottom = F.col("gy") + F.col("row") * F.col("sy"), F.col("gy") + (F.col("row") + 1) * F.col("sy")
    y, y0, y1 = F.col("gy") + (F.col("row") + 0.5) * F.col("sy"), F.least(top, bottom), F.greatest(top, bottom)
    p, q = F.col("a"), F.col("b")
    at = lambda t: p["x"] + (q["x"] - p["x"]) * F.try_divide(t - p["y"], q["y"] - p["y"])
    cut = lambda v: F.when(p["y"] == q["y"], v["x"]).otherwise(F.when(v["y"] < y0, at(y0)).when(v["y"] > y1, at(y1)).otherwise(v["x"]))
    left, right = column(F.least(cut(p), cut(q))), column(F.greatest(cut(p), cut(q)))
    left, right = F.least(left, right), F.greatest(left, right)
    # An upright edge on the border of two cells enters neither.
    last = F.when(left == right, F.when(left == F.floor(left), F.floor(left) - 1).otherwise(F.floor(left))).otherwise(F.ceil(right) - 1)
    crossed = F.when((p["y"] > y) != (q["y"] > y), column((q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]))
    span = F.struct(F.floor(left).cast("long").alias("lo"), last.cast("long").alias("hi"))
    each = each.select(*ids, *carried, "part", "row", crossed.alias("x"), F.when(last >= F.floor(left), span).alias("span"), F.struct("a", "b").alias("edge"))
    return each.groupBy(*ids, "part", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.collect_set("span").alias("touched"), F.collect_list("edge").alias("edges"), *(F.first(c).alias(c) for c in carried))


def centre_spans(xs: Column) -> Column:
    """Inclusive ranges of the columns whose middles lie between the first and second crossing, the third and fourth and so on."""
    pairs = F.filter(F.transform(xs, lambda v, i: F.struct(v.alias("lo"), F.get(xs, i + 1).alias("hi"), i.alias("i"))), lambda s: s["i"] % 2 == 0)
    spans = F.transform(pairs, lambda s: F.struct(F.ceil(s["lo"] - 0.5).cast("long").alias("lo"), (F.ceil(s["hi"] - 0.5) - 1).cast("long").alias("hi")))
    return F.filter(spans, lambda s: s["lo"] <= s["hi"])


def covering(polygons: DataFrame) -> tuple[DataFrame, list[int]]:
    """(level, cx, cy, r, inner, edges) of the cells that cover each polygon, r being its other columns, and the levels.

    A cell that no edge enters and whose middle is inside is an inner one; the others carry the edges of their row by part, which decide for
    every point of the row.
    """
    kept = [c for c in polygons.columns if c not in ("rings", "parts")]
    own, levels = _cover_level(whole(polygons))
    size = F.pow(F.lit(2.0), "level")
    each = own.select(F.monotonically_increasing_id().alias("p"), F.struct(*(kept or [F.lit(0).alias("_none")])).alias("r"), "level", F.posexplode("parts").alias("part", "rings")).withColumn("e", F.explode(edges(F.col("rings"))))
    each = each.select("p", "r", "level", "part", F.col("e.a").alias("a"), F.col("e.b").alias("b"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), size.alias("sx"), size.alias("sy"), F.lit(None).cast("long").alias("r0"), F.lit(None).cast("long").alias("r1"))
    rows = rows_of_edges(each, ["p", "level"], ("r",)).withColumnRenamed("row", "cy")
    cells = lambda spans: F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["lo"], s["hi"]))))
    rows = rows.withColumn("border", cells(F.col("touched"))).withColumn("inner", F.array_except(cells(centre_spans(F.col("xs"))), "border"))
    # A polygon has at most 17 rows of at most 17 cells.
    rows = rows.groupBy("p", "level", "cy").agg(F.first("r").alias("r"), F.array_distinct(F.flatten(F.collect_list("inner"))).alias("inner"), F.array_distinct(F.flatten(F.collect_list("border"))).alias("border"), F.collect_list("edges").alias("edges"))
    kind = lambda cells, inner: F.transform(cells, lambda c: F.struct(c.alias("cx"), F.lit(inner).alias("inner")))
    each = rows.select("level", "cy", "r", "edges", F.explode(F.concat(kind("inner", True), kind(F.array_except("border", "inner"), False))).alias("c"))
    return each.select("level", "c.cx", "cy", "r", "c.inner", F.when(~F.col("c.inner"), F.col("edges")).alias("edges")), levels


def points_in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """points (x, y, ...) with geom_id and the other columns of every polygon that holds them."""
    kept = [c for c in polygons.columns if c not in ("rings", "parts")]
    if "parts" in polygons.columns and not polygons.filter(F.size("parts") > MANY_PARTS).isEmpty():
        # Cells of such a polygon's size would carry the edges of many parts, so its parts are covered each by itself and a point counts once.
        few, many = polygons.filter(F.size("parts") <= MANY_PARTS), polygons.filter(F.size("parts") > MANY_PARTS)
        marked = points.withColumn("_point", F.monotonically_increasing_id())
        each = many.withColumn("_polygon", F.monotonically_increasing_id()).select(*kept, "_polygon", F.explode("parts").alias("rings"))
        once = points_in_polygons(marked, each)
        of = F.struct(*(c for c in once.columns if c not in ("_point", "_polygon")))
        once = once.groupBy("_point", "_polygon").agg(F.first(of).alias("_of")).select("_of.*")
        return points_in_polygons(points, few).unionByName(once)
    cells, levels = covering(polygons)
    x, y = F.col("row.x"), F.col("row.y")
    within = F.col("inner") | F.exists("edges", lambda part: F.aggregate(part, F.lit(False), lambda odd, e: odd != _crosses(e, x, y)))
    hit = _keyed_points(points, levels).join(cells, ["level", "cx", "cy"]).filter(within)
    return hit.select("row.*", *(F.col(f"r.{c}") for c in kept))


def box_meets(parts: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the inside of a box meets the inside of a polygon of parts."""

    def part(rings: Column) -> Column:
        touched = F.exists(edges(rings), lambda e: segment_meets_open_box(e["a"], e["b"], x0, y0, x1, y1))
        return touched | contains(rings, (x0 + x1) / 2, (y0 + y1) / 2)

    return F.exists(parts, part)


def covers_box(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a box lies inside rings."""
    touched = F.exists(edges(rings), lambda e: segment_meets_open_box(e["a"], e["b"], x0, y0, x1, y1))
    return ~touched & contains(rings, (x0 + x1) / 2, (y0 + y1) / 2)


def upright(rings: Column) -> Column:
    """Whether rings are one rectangle along the axes."""
    p = [F.get(F.get(rings, 0), k) for k in range(5)]
    aside = [(a["x"] == b["x"]) != (a["y"] == b["y"]) for a, b in zip(p, p[1:])]
    across = [(a[k] != b[k]) for a, b in ((p[0], p[2]), (p[1], p[3])) for k in ("x", "y")]
    return F.coalesce((F.size(rings) == 1) & (F.size(F.get(rings, 0)) == 5) & (p[0] == p[4]) & functools.reduce(Column.__and__, aside + across), F.lit(False))


def polygons_meet(one: Column, other: Column) -> Column:
    """Whether two polygons of parts have a point in common: an edge of one crosses or touches one of the other, or one holds the other."""
    flat = lambda parts: F.flatten(F.transform(parts, edges))

    def between(a: Column, b: Column, p: Column) -> Column:
        return p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def cross(e: Column, f: Column) -> Column:
        turn = lambda s, p: F.signum(_side(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], p["x"], p["y"]))
        t = [turn(e, f["a"]), turn(e, f["b"]), turn(f, e["a"]), turn(f, e["b"])]
        on = ((t[0] == 0) & between(e["a"], e["b"], f["a"])) | ((t[1] == 0) & between(e["a"], e["b"], f["b"])) | ((t[2] == 0) & between(f["a"], f["b"], e["a"])) | ((t[3] == 0) & between(f["a"], f["b"], e["b"]))
        return ((t[0] * t[1] < 0) & (t[2] * t[3] < 0)) | on

    def holds(a: Column, b: Column) -> Column:
        return F.exists(b, lambda rings: inside(a, *(F.get(F.get(rings, 0), 0)[k] for k in ("x", "y"))))

    # Few steps tell that one has the other's first point, so most pairs need no pairs of edges.
    return holds(one, other) | holds(other, one) | F.exists(flat(one), lambda e: F.exists(flat(other), lambda f: cross(e, f)))


def polygons_meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of the polygons that meet: extents by cells, then edges."""
    hit = box_pairs(whole(left), whole(right)).filter(polygons_meet(F.col("l.parts"), F.col("r.parts")))
    return hit.select(F.col("l.geom_id").alias("left_id"), F.col("r.geom_id").alias("right_id"))


def cells_touching(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """cells (x0, y0, x1, y1, ...) that meet a polygon (R14, all touched)."""
    boxes = cells.select(F.struct(*cells.columns).alias("row"), F.col("x0").alias("minx"), F.col("y0").alias("miny"), F.col("x1").alias("maxx"), F.col("y1").alias("maxy"))
    kept = [c for c in polygons.columns if c not in ("rings", "parts")]
    hit = box_pairs(boxes, whole(polygons)).filter(box_meets(F.col("r.parts"), *(F.col(f"l.row.{k}") for k in ("x0", "y0", "x1", "y1"))))
    return hit.select("l.row.*", *(F.col(f"r.{c}") for c in kept))


_BOUNDS = ("minx", "miny", "maxx", "maxy")


def regions_meeting(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Regions (region_id, minx, miny, maxx, maxy) that meet any box."""
    return regions.join(_extents_meeting(regions, boxes), list(_BOUNDS), "left_semi").select(*regions.columns)


def boxes_without_region(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Boxes that meet no region."""
    return boxes.join(_extents_meeting(boxes, regions), list(_BOUNDS), "left_anti").select(*boxes.columns)


def _extents_meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct extents of ``left`` that meet one of ``right``.

    A pair meets on cells of the larger one's level, so a box of any size takes few cells for each level of the other side.
    """
    level = F.ceil(F.log2(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1e-9)))).cast("int")
    a, b = (t.select(*(F.col(k).cast("double").alias(k) for k in _BOUNDS)).dropna().distinct().withColumn("level", level) for t in (left, right))
    of_a, of_b = ([r[0] for r in t.select("level").distinct().collect()] for t in (a, b))
    b = _on_levels(b, of_a).select("cx", "cy", F.col("level").alias("other"), F.col("other").alias("level"), *(F.col(k).alias(f"b_{k}") for k in _BOUNDS))
    keys = ["level", "other", "cx", "cy"]
    a = _on_levels(a, of_b).alias("a")
    hit = a.join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [_boxes_meet()], "left_semi")
    return hit.select(*_BOUNDS).distinct()


def _on_levels(boxes: DataFrame, levels: list[int]) -> DataFrame:
    """A row for each of the other side's levels and each cell that a box meets at the higher level of the two."""
    p = boxes.withColumn("other", F.explode(F.lit(levels).cast("array<int>")))
    size = F.pow(F.lit(2.0), F.greatest("level", "other"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long")))
    return p.withColumn("cx", span("minx", "maxx")).withColumn("cy", span("miny", "maxy"))


def _boxes_meet() -> Column:
    return (F.col("minx") <= F.col("b_maxx")) & (F.col("maxx") >= F.col("b_minx")) & (F.col("miny") <= F.col("b_maxy")) & (F.col("maxy") >= F.col("b_miny"))


def parts(multi: DataFrame) -> DataFrame:
    """A row for each part of (geom_id, parts)."""
    return multi.select("geom_id", F.posexplode("parts").alias("part", "rings"))


def wkt_rings(text: Column) -> Column:
    """Rings of POLYGON and MULTIPOLYGON texts."""
    body = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1)
    pair = lambda v: F.struct(v[0].cast("double").alias("x"), v[1].cast("double").alias("y"))
    return F.transform(body, lambda ring: F.transform(F.transform(F.split(ring, ","), lambda p: F.split(F.trim(p), r"\s+")), pair))


def clip_ring(ring: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    """A ring cut to a rectangle, side by side; [] where nothing is left."""
    pts = ring[:-1] if ring and ring[0] == ring[-1] else list(ring)
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for p, q in zip(pts, pts[1:] + pts[:1]):
            dp, dq = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if dp >= 0:
                out.append(p)
            if (dp > 0 > dq) or (dp < 0 < dq):
                t = dp / (dp - dq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        pts = out
    return [*pts, pts[0]] if len(pts) > 2 else []


def clip_to_half_planes(ring: Column, planes: Column) -> Column:
    """A closed ring cut to the half-planes a * x + b * y + c >= 0 one after the other; empty where nothing is left.

    ``planes``: array<struct<a, b, c>>.  The result is exact for convex clip areas.
    """
    none = F.array().cast(f"array<{_POINT}>")

    def cut(points: Column, h: Column) -> Column:
        far = lambda p: h["a"] * p["x"] + h["b"] * p["y"] + h["c"]

        def side(p: Column, q: Column) -> Column:
            dp, dq = far(p), far(q)
            t = F.try_divide(dp, dp - dq)
            met = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
            return F.concat(F.when(dp >= 0, F.array(p)).otherwise(none), F.when(dp * dq < 0, F.array(met)).otherwise(none))

        turned = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
        return F.when(F.size(points) == 0, none).otherwise(F.flatten(F.zip_with(points, turned, side)))

    open_ring = F.slice(ring, 1, F.size(ring) - 1)
    left = F.aggregate(planes, open_ring.cast(f"array<{_POINT}>"), cut)
    return F.transform(F.array(left), lambda r: F.when(F.size(r) > 2, F.concat(r, F.slice(r, 1, 1))).otherwise(none))[0]


def box_planes(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The four half-planes of a rectangle."""
    plane = lambda a, b, c: F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), c.cast("double").alias("c"))
    return F.array(plane(1, 0, -x0), plane(-1, 0, x1), plane(0, 1, -y0), plane(0, -1, y1))


def _cut(rings: Column, planes: Column) -> Column:
    return F.filter(F.transform(rings, lambda ring: clip_to_half_planes(ring, planes)), lambda ring: F.size(ring) > 0)


def clipped(polygons: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Polygons cut to a rectangle, empty ones dropped."""
    kept = polygons.columns
    # Only what crosses the rectangle's border is cut.
    p = polygons.withColumns({f"_{k}": v for k, v in bounds(F.col("rings")).items()})
    p = p.filter((F.col("_maxx") >= x0) & (F.col("_minx") <= x1) & (F.col("_maxy") >= y0) & (F.col("_miny") <= y1))
    within = (F.col("_minx") >= x0) & (F.col("_maxx") <= x1) & (F.col("_miny") >= y0) & (F.col("_maxy") <= y1) & F.forall("rings", lambda r: (F.size(r) > 3) & (r[0] == r[F.size(r) - 1]))
    rings = F.when(within, F.col("rings")).otherwise(_cut(F.col("rings"), box_planes(*map(F.lit, (x0, y0, x1, y1)))))
    # Out of a generator, as filters on what comes of the rings would have them cut again for each mention.
    return p.select(*(c for c in kept if c != "rings"), F.explode(F.array(rings)).alias("rings")).filter(F.size("rings") > 0).select(*kept)


def area(rings: Column) -> Column:
    """Area of rings: the first one less the others."""
    one = lambda ring: F.abs(F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + F.get(ring, i - 1)["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"])) / 2
    return F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), one(rings[0]), lambda s, ring: s - one(ring))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The closed ring of a box."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def boxes_as_polygons(boxes: DataFrame) -> DataFrame:
    """``boxes`` (minx, miny, maxx, maxy, ...) with their rings instead of the extent."""
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(point("minx", "miny"), point("maxx", "miny"), point("maxx", "maxy"), point("minx", "maxy"), point("minx", "miny"))
    return boxes.select("*", F.array(ring).alias("rings")).drop(*_BOUNDS)


def esri_envelope(minx: Column, miny: Column, maxx: Column, maxy: Column, wkid: int = 4326) -> Column:
    """The JSON text by which a box is sent to a map service."""
    return F.to_json(F.struct(minx.alias("xmin"), miny.alias("ymin"), maxx.alias("xmax"), maxy.alias("ymax"), F.struct(F.lit(wkid).alias("wkid")).alias("spatialReference")))


def swath(track: Column, reach: float = SWATH_REACH) -> Column:
    """Parts of the strip about a polyline array<struct<x, y>>: a rectangle for each piece, longer by ``reach`` at both ends."""
    pairs = F.zip_with(F.slice(track, 1, F.size(track) - 1), F.slice(track, 2, F.size(track) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def strip(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        long = F.sqrt(dx * dx + dy * dy)
        ux, uy = F.try_divide(dx * reach, long), F.try_divide(dy * reach, long)
        at = lambda p, along, across: F.struct((p["x"] + along * ux - across * uy).alias("x"), (p["y"] + along * uy + across * ux).alias("y"))
        return F.array(F.array(at(e["a"], -1, -1), at(e["b"], 1, -1), at(e["b"], 1, 1), at(e["a"], -1, 1), at(e["a"], -1, -1)))

    return F.transform(pairs, strip)


def near_track(x: Column, y: Column, track: Column, reach: float) -> Column:
    """Whether a point is within reach of a polyline array<struct<x, y>>."""
    pairs = F.zip_with(F.slice(track, 1, F.size(track) - 1), F.slice(track, 2, F.size(track) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def close(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        px, py = x - e["a"]["x"], y - e["a"]["y"]
        long = F.sqrt(dx * dx + dy * dy)
        along = F.try_divide(px * dx + py * dy, long)
        across = F.try_divide(F.abs(px * dy - py * dx), long)
        # Ends are square: the strip goes on by its half width.
        return F.coalesce((across <= reach) & (along >= -reach) & (along <= long + reach), F.lit(False))

    return F.exists(pairs, close)


def minimal_cover(tiles: list[tuple[str, tuple[float, float, float, float]]], boxes: list[tuple[float, float, float, float]]) -> list[str]:
    """Fewest tiles whose union covers all boxes, the first such set in tile order.

    Coverage is tested on the grid of all edges.  The list is that of the tiles that one query area meets.
    """
    xs = sorted({v for b in [*boxes, *(t for _, t in tiles)] for v in (b[0], b[2])})
    ys = sorted({v for b in [*boxes, *(t for _, t in tiles)] for v in (b[1], b[3])})
    inside = lambda b, x, y: b[0] <= x <= b[2] and b[1] <= y <= b[3]
    mids = [((a + b) / 2, (c + d) / 2) for a, b in zip(xs, xs[1:]) for c, d in zip(ys, ys[1:])]
    need = {i for i, (x, y) in enumerate(mids) if any(inside(b, x, y) for b in boxes)}
    cover = [{i for i in need if inside(t, *mids[i])} for _, t in tiles]
    return minimal_cover_of([(t, c) for (t, _), c in zip(tiles, cover)], need)


def minimal_cover_of(sets: list[tuple[str, set[int]]], need: set[int]) -> list[str]:
    """Names of the fewest sets whose union holds all of ``need``, the first such choice in order.

    Elements with the same sets are one, and an element whose sets include all of another's is held with it.  What is left falls into parts
    that share no set; in each the size is found by branch and bound, and the sets by trying them in order.
    """
    holders = {e: sum(1 << i for i, (_, held) in enumerate(sets) if e in held) for e in need}
    if not all(holders.values()):
        raise ValueError("the tiles do not cover the area")
    picked = [i for part in _apart(_minimal(list(holders.values()))) for i in _first_cover(part)]
    return [sets[i][0] for i in sorted(picked)]


def _apart(masks: list[int]) -> list[list[int]]:
    """Groups of masks that share no bit."""
    groups: list[tuple[int, list[int]]] = []
    for m in masks:
        joined = [g for g in groups if g[0] & m]
        groups = [g for g in groups if not g[0] & m]
        groups.append((functools.reduce(int.__or__, (g[0] for g in joined), m), [m, *itertools.chain.from_iterable(g[1] for g in joined)]))
    return [g[1] for g in groups]


def _minimal(masks: list[int]) -> list[int]:
    """Masks that include no other one: what meets these meets all."""
    out: list[int] = []
    for m in sorted(set(masks), key=int.bit_count):
        if not any(o & m == o for o in out):
            out.append(m)
    return out


def _coverable(masks: list[int], most: int) -> bool:
    """Whether ``most`` bits meet every mask."""
    masks = _minimal(masks)
    if not masks:
        return True
    forced = functools.reduce(int.__or__, (m for m in masks if m.bit_count() == 1), 0)
    if forced:
        return forced.bit_count() <= most and _coverable([m for m in masks if not m & forced], most - forced.bit_count())
    degree = collections.Counter(i for m in masks for i in _bits(m))
    # Masks that share no bit need one each; those whose bits are in few masks first.
    seen, least = 0, 0
    for m in sorted(masks, key=lambda m: (m.bit_count(), sum(degree[i] for i in _bits(m)))):
        if not m & seen:
            seen, least = seen | m, least + 1
    if least > most:
        return False
    i = max(degree, key=lambda i: (degree[i], -i))
    return _coverable([m for m in masks if not m >> i & 1], most - 1) or _coverable([m & ~(1 << i) for m in masks], most)


def _bits(m: int) -> list[int]:
    return [i for i in range(m.bit_length()) if m >> i & 1]


def _first_cover(masks: list[int]) -> list[int]:
    """The first choice in order of the fewest bits that meet every mask."""
    most = next(k for k in itertools.count(1) if _coverable(masks, k))
    out: list[int] = []
    for i in range(max(m.bit_length() for m in masks)):
        if not masks:
            break
        rest = [m >> i + 1 << i + 1 for m in masks if not m >> i & 1]
        if all(rest) and len(rest) < len(masks) and _coverable(rest, most - len(out) - 1):
            out.append(i)
            masks = rest
        else:
            masks = [m & ~(1 << i) for m in masks]
    return out


def wkt_bounds(text: str) -> tuple[float, float, float, float]:
    """Extent of a WKT text on the driver."""
    n = [float(x) for x in re.findall(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", text)]
    return min(n[::2]), min(n[1::2]), max(n[::2]), max(n[1::2])
