"""Overlay of any polygons, concave, with holes and of several parts: intersection, difference, union and its boundary.

Edges are cut at all heights at which an edge of their group ends or two of them cross.  Between two such heights, in a slab, edges do not
cross, so their order from left to right tells where a polygon begins and ends: of the edges of one part the first, third and so on
enter it, and a running sum of entries less exits says how many parts cover the place (even-odd within a part, so parts may overlap).  What
is inside becomes a trapezoid between two edges; trapezoids between the same two edges are joined over slabs.

Groups of few edges, as nearly all pairs of polygons and cells of a union are, stay rows and are worked out batch by batch (``slabs``).  For the
others everything is an equi-join or a window by group and slab: no task holds a polygon.  They are cut into bands, so that edges and
slabs meet within a band only.  Unions of many parts are cut by a grid of cells first; where parts lie on one another the cells are
smaller than parts, and a cell that one part covers is a piece whatever else meets it, so the work grows with the distinct parts, not their depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from . import geometry, slabs

#: Edges of a band, parts of a union that are not cut into cells, and parts of a cell.
BAND_EDGES, WHOLE_PARTS, CELL_PARTS = 64, 256, 16
#: Points of a group that stays a row; parts over one another, on average, from which cells are smaller than parts; cells of a part, then.
ROW_POINTS, DEEP, DEEP_CELLS = 320, 2, 32
#: Slabs and pieces thinner than this part of their coordinates come from rounding.
THIN = 1e-13

_EDGE = ["x0", "y0", "x1", "y1"]


def edge_rows(polygons: DataFrame, group: list[str]) -> DataFrame:
    """(group, side, part, x0, y0, x1, y1): the edges of ``parts`` that are not level, from their lower end up.

    ``polygons``: group, side (0 or 1), own (what tells the polygons of a side apart) and parts.
    """
    each = polygons.select(*group, "side", "own", F.posexplode("parts").alias("_k", "rings"))
    each = each.select(*group, "side", F.struct("own", "_k").alias("part"), F.explode(geometry.edges(F.col("rings"))).alias("e")).filter("e.a.y <> e.b.y")
    up = F.col("e.a.y") < F.col("e.b.y")
    end = lambda first, k: F.when(up, F.col(f"e.{'a' if first else 'b'}.{k}")).otherwise(F.col(f"e.{'b' if first else 'a'}.{k}"))
    return each.select(*group, "side", "part", end(True, "x").alias("x0"), end(True, "y").alias("y0"), end(False, "x").alias("x1"), end(False, "y").alias("y1"))


def _thin(a: Column | str, b: Column | str) -> Column:
    return THIN * F.greatest(F.abs(a), F.abs(b))


def _at(y: Column) -> Column:
    """x of an edge at a height; its own ends exactly."""
    x = F.col("x0") + (F.col("x1") - F.col("x0")) * ((y - F.col("y0")) / (F.col("y1") - F.col("y0")))
    return F.when(y == F.col("y0"), F.col("x0")).when(y == F.col("y1"), F.col("x1")).otherwise(x)


def _banded(edges: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges once for each band of their group that they enter, and the heights between bands."""
    span = edges.groupBy(*group).agg(F.min("y0").alias("_lo"), F.max("y1").alias("_hi"), F.greatest(F.lit(1), F.floor(F.count("*") / BAND_EDGES)).cast("int").alias("_k"))
    tall = (F.col("_hi") - F.col("_lo")) / F.col("_k")
    band = lambda y: F.least(F.col("_k") - 1, F.greatest(F.lit(0), F.floor((y - F.col("_lo")) / tall))).cast("int")
    cut = span.filter("_k > 1").withColumn("b", F.explode(F.sequence(F.lit(1), F.col("_k") - 1))).select(*group, (F.col("_lo") + F.col("b") * tall).alias("y"))
    # An end on a border may fall to either band by rounding, so edges also enter the bands beside their ends'.
    near = F.sequence(F.greatest(F.lit(0), band(F.col("y0")) - 1), F.least(F.col("_k") - 1, band(F.col("y1")) + 1))
    rows = edges.join(span, group).withColumn("band", F.explode(near))
    return rows, cut


def pieces(edges: DataFrame, group: list[str], inside: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, lo, hi, l_lo, l_hi, r_lo, r_hi): trapezoids that do not overlap, where ``inside`` holds of the numbers of parts of sides 0 and 1."""
    # Edges are read several times; what they come from is worked out once.
    edges = stored(edges, "edges")
    rows, borders = _banded(edges, group)
    rows = stored(rows, "banded")
    spread = rows.select(*group, "band", *_EDGE)
    # Heights at which two edges cross within their spans; edges that only touch end there.
    key = [*group, "band"]
    a, b = spread.select(*key, *(F.col(k).alias(f"a_{k}") for k in _EDGE)), spread.select(*key, *(F.col(k).alias(f"b_{k}") for k in _EDGE))
    slope = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) / (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    met = a.join(b, key).filter(F.struct(*(f"a_{k}" for k in _EDGE)) < F.struct(*(f"b_{k}" for k in _EDGE)))
    met = met.filter((F.greatest("a_y0", "b_y0") < F.least("a_y1", "b_y1")) & (F.greatest("a_x0", "a_x1") >= F.least("b_x0", "b_x1")) & (F.greatest("b_x0", "b_x1") >= F.least("a_x0", "a_x1")))
    y = F.try_divide(F.col("b_x0") - F.col("a_x0") + slope("a") * F.col("a_y0") - slope("b") * F.col("b_y0"), slope("a") - slope("b"))
    met = met.withColumn("y", y).filter((F.col("y") > F.greatest("a_y0", "b_y0")) & (F.col("y") < F.least("a_y1", "b_y1"))).select(*group, "y")
    heights = edges.select(*group, F.explode(F.array("y0", "y1")).alias("y")).unionByName(met).unionByName(borders).distinct()
    up = Window.partitionBy(*group).orderBy("y")
    # Heights that differ by rounding are one, the lowest of them.
    heights = heights.withColumn("below", F.lag("y").over(up)).filter(F.col("below").isNull() | (F.col("y") - F.col("below") > _thin("y", "below")))
    slabs = heights.select(*group, F.col("y").alias("lo"), F.lead("y").over(up).alias("hi")).filter("hi is not null")

    middle = (F.col("lo") + F.col("hi")) / 2
    span = rows.select(*group, "_lo", "_hi", "_k").distinct()
    slabs = slabs.join(span, group).withColumn("band", F.least(F.col("_k") - 1, F.floor((middle - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / F.col("_k")))).cast("int")).select(*key, "lo", "hi")
    cut = rows.select(*key, "side", "part", *_EDGE).join(slabs, key).filter((F.col("y0") <= F.col("lo") + _thin("lo", "hi")) & (F.col("y1") >= F.col("hi")))
    cut = cut.select(*group, "side", "part", "lo", "hi", F.struct(*_EDGE).alias("edge"), _at(middle).alias("at"), _at(F.col("lo")).alias("x_lo"), _at(F.col("hi")).alias("x_hi"))
    # One shuffle serves the windows of a slab.
    slab = [*group, "lo"]
    cut = cut.repartition(*slab)
    own = F.row_number().over(Window.partitionBy(*slab, "side", "part").orderBy("at", "edge"))
    cut = cut.withColumn("enter", F.when(own % 2 == 1, 1).otherwise(-1))
    across = Window.partitionBy(*slab).orderBy("at", F.col("enter").desc(), "side", "part", "edge")
    so_far = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("enter"))).over(so_far), F.lit(0))
    cut = cut.withColumns({"n0": count(0), "n1": count(1)}).withColumn("within", inside(F.col("n0"), F.col("n1")))
    # A gap of no width, between sides that differ by rounding, is none.
    closed = F.lead("within").over(across) & (F.lead("at").over(across) - F.col("at") <= _thin("at", F.lead("at").over(across)))
    cut = cut.withColumn("within", F.col("within") | F.coalesce(closed, F.lit(False)))
    cut = cut.withColumn("before", F.coalesce(F.lag("within").over(across), F.lit(False))).filter("within <> before")
    right = lambda c: F.lead(c).over(across)
    found = cut.withColumns({"r": right("edge"), "r_at": right("at"), "r_lo": right("x_lo"), "r_hi": right("x_hi")}).filter("within")
    found = found.filter(F.col("r_at") - F.col("at") > _thin("at", "r_at"))
    # Trapezoids between the same two edges, one above the other, are one.
    stack = Window.partitionBy(*group, "edge", "r").orderBy("lo")
    found = found.withColumn("new", F.coalesce(F.lag("hi").over(stack) != F.col("lo"), F.lit(True)).cast("int"))
    found = found.withColumn("run", F.sum("new").over(stack.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = [F.min("lo").alias("_l"), F.max("hi").alias("_h"), *(f(c, "lo").alias(n) for f, c, n in ((F.min_by, "x_lo", "l_lo"), (F.max_by, "x_hi", "l_hi"), (F.min_by, "r_lo", "r_lo"), (F.max_by, "r_hi", "r_hi")))]
    return found.groupBy(*group, "edge", "r", "run").agg(*ends).select(*group, F.col("_l").alias("lo"), F.col("_h").alias("hi"), "l_lo", "l_hi", "r_lo", "r_hi")


def _points(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, rings: n + F.aggregate(rings, F.lit(0), lambda m, ring: m + F.size(ring)))


def _found(rows: DataFrame, group: list[str], inside: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, found) of groups that are rows (group, mine, other): their trapezoids as an array."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*group).schema)
    return rows.select(*group, "mine", "other").mapInArrow(slabs.found_in(group, inside, THIN), f"{kinds}, found {slabs.FOUND}")


def _gathered(found: DataFrame, group: list[str]) -> DataFrame:
    """(group, found) of single trapezoids."""
    return found.groupBy(*group).agg(F.collect_list(F.struct(*slabs.FIELDS)).alias("found"))


def _by_pair(pairs: DataFrame, group: list[str], most: int, inside: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, found) of ``pairs`` (group, mine, other), of which none has more than ``most`` points."""
    if most <= ROW_POINTS:
        return _found(pairs, group, inside)
    pairs = pairs.withColumn("_n", _points(F.col("mine")) + _points(F.col("other")))
    few, many = _found(pairs.filter(F.col("_n") <= ROW_POINTS), group, inside), pairs.filter(F.col("_n") > ROW_POINTS)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("mine").alias("parts")), F.struct(F.lit(1).alias("side"), F.col("other").alias("parts")))
    many = many.select(*group, F.explode(sides).alias("s")).select(*group, "s.side", F.lit(0).alias("own"), "s.parts")
    return few.unionByName(_gathered(pieces(edge_rows(many, group), group, inside), group))


def _by_group(items: DataFrame, group: list[str], inside: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, found) of ``items`` (group, side, own, parts): those of a group together where they have few points."""
    every = Window.partitionBy(*group)
    so_far = every.orderBy("side", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    items = items.withColumn("_p", _points(F.col("parts"))).withColumns({"_n": F.sum("_p").over(every), "_at": F.sum("_p").over(so_far)})
    # Larger groups are stored in lots of about as many points, so no row is large.
    lot = F.when(F.col("_n") <= ROW_POINTS, F.lit(0)).otherwise(F.floor(F.col("_at") / ROW_POINTS)).cast("long")
    items = items.groupBy(*group, lot.alias("_lot")).agg(F.first("_n").alias("_n"), F.collect_list(F.struct("side", "own", "parts")).alias("items"))
    items = stored(items, "groups")
    of = lambda side: F.flatten(F.transform(F.filter("items", lambda i: i["side"] == side), lambda i: i["parts"]))
    few = _found(items.filter(F.col("_n") <= ROW_POINTS).select(*group, of(0).alias("mine"), of(1).alias("other")), group, inside)
    many = items.filter(F.col("_n") > ROW_POINTS)
    if many.isEmpty():
        return few
    many = many.select(*group, F.explode("items").alias("i")).select(*group, "i.*")
    return few.unionByName(_gathered(pieces(edge_rows(many, group), group, inside), group))


def piece_area() -> Column:
    return (F.col("hi") - F.col("lo")) * ((F.col("r_lo") - F.col("l_lo")) + (F.col("r_hi") - F.col("l_hi"))) / 2


def piece_ring() -> Column:
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(point("l_lo", "lo"), point("r_lo", "lo"), point("r_hi", "hi"), point("l_hi", "hi"), point("l_lo", "lo"))


def as_parts(found: DataFrame, group: list[str]) -> DataFrame:
    """(group, parts, area): the trapezoids of a group as the parts of one polygon."""
    return _as_parts(_gathered(found, group), group)


def _as_parts(found: DataFrame, group: list[str]) -> DataFrame:
    point = lambda t, x, y: F.struct(t[x].alias("x"), t[y].alias("y"))
    ring = lambda t: F.array(F.array(*(point(t, *at) for at in (("l_lo", "lo"), ("r_lo", "lo"), ("r_hi", "hi"), ("l_hi", "hi"), ("l_lo", "lo")))))
    area = F.aggregate("found", F.lit(0.0), lambda s, t: s + (t["hi"] - t["lo"]) * ((t["r_lo"] - t["l_lo"]) + (t["r_hi"] - t["l_hi"])) / 2)
    return found.select(*group, F.transform("found", ring).alias("parts"), area.alias("area"))


def _common(polygons: DataFrame, areas: DataFrame) -> DataFrame:
    """(geom_id, area_id, found): the trapezoids that each polygon has in common with each area."""
    a, b = (geometry.whole(t.select("geom_id", "parts" if "parts" in t.columns else "rings")) for t in (polygons, areas))
    pairs = geometry.box_pairs(a, b).select(F.col("l.geom_id").alias("geom_id"), F.col("r.geom_id").alias("area_id"), F.col("l.parts").alias("mine"), F.col("r.parts").alias("other"))
    # Two numbers: points of the largest of either side.
    most = sum(t.agg(F.max(_points(F.col("parts")))).first()[0] or 0 for t in (a, b))
    return _by_pair(pairs, ["geom_id", "area_id"], most, lambda mine, other: (mine > 0) & (other > 0))


def common_pieces(polygons: DataFrame, areas: DataFrame) -> DataFrame:
    """(geom_id, area_id, lo, hi, l_lo, l_hi, r_lo, r_hi): what each polygon has in common with each area; geom_id is a key of either side."""
    return _common(polygons, areas).select("geom_id", "area_id", F.inline("found"))


def clipped_to(polygons: DataFrame, areas: DataFrame) -> DataFrame:
    """(geom_id, area_id, parts, area) of polygons cut to each area that they share more than a border with."""
    return _as_parts(_common(polygons, areas), ["geom_id", "area_id"])


def without(polygons: DataFrame, areas: DataFrame) -> DataFrame:
    """(geom_id, parts, area) of what polygons have outside all areas; those wholly inside go."""
    a, b = (geometry.whole(t.select("geom_id", "parts" if "parts" in t.columns else "rings")) for t in (polygons, areas))
    near = geometry.box_pairs(a, b).select(F.col("l.geom_id").alias("geom_id"), F.lit(1).alias("side"), F.col("r.geom_id").cast("string").alias("own"), F.col("r.parts").alias("parts"))
    items = a.select("geom_id", F.lit(0).alias("side"), F.lit("").alias("own"), "parts").unionByName(near)
    return _as_parts(_by_group(items, ["geom_id"], lambda mine, other: (mine > 0) & (other == 0)), ["geom_id"])


def _in_cells(polygons: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy, side, own, parts): the distinct parts of each key, those of keys with many parts cut by a grid.

    A cell has about ``CELL_PARTS`` parts; where more than ``DEEP`` lie on one another it is half as wide as a part, and what one part covers is
    one part of that extent.
    """
    each = polygons.select(key, F.explode("parts").alias("rings")).dropDuplicates([key, "rings"])
    each = each.withColumns(geometry.bounds(F.col("rings"))).withColumn("upright", geometry.upright(F.col("rings")))
    wide, tall = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    of_key = each.groupBy(key).agg(F.count("*").alias("n"), ((F.max("maxx") - F.min("minx")) * (F.max("maxy") - F.min("miny"))).alias("all"), F.avg(F.greatest(wide, tall)).alias("side"), F.avg(F.least(wide, tall)).alias("short"), F.avg(wide * tall).alias("box"))
    power = lambda v, way: F.pow(F.lit(2.0), way(F.log2(F.greatest(v, F.lit(1e-12)))))
    # Cells are no smaller than twice the mean part, so a part is in few of them.
    loose = power(F.greatest(F.sqrt(F.col("all") * CELL_PARTS / F.col("n")), 2 * F.col("side")), F.ceil)
    # The parts of a key are in no more than DEEP_CELLS cells each, on average: box / size^2 + girth / size + 1.
    girth = F.col("side") + F.col("short")
    least = (girth + F.sqrt(girth * girth + 4 * (DEEP_CELLS - 1) * F.col("box"))) / (2 * (DEEP_CELLS - 1))
    close = F.least(loose, F.greatest(power(F.col("short") / 2, F.floor), power(least, F.ceil)))
    size = F.when(F.col("n") > WHOLE_PARTS, F.when(F.col("n") * F.col("box") > DEEP * F.col("all"), close).otherwise(loose))
    each = each.join(of_key.select(key, size.alias("size")), key)
    cells = lambda lo, hi: F.when(F.col("size").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(F.col(lo) / F.col("size")).cast("long"), F.floor(F.col(hi) / F.col("size")).cast("long")))
    each = each.withColumn("cx", F.explode(cells("minx", "maxx"))).withColumn("cy", F.explode(cells("miny", "maxy")))
    corners = [(F.col(c) + i) * F.col("size") for i in (0, 1) for c in ("cx", "cy")]
    x0, y0, x1, y1 = corners
    whole = F.col("size").isNull()
    within = whole | ((F.col("minx") >= x0) & (F.col("maxx") <= x1) & (F.col("miny") >= y0) & (F.col("maxy") <= y1))
    over = ~whole & (F.col("minx") <= x0) & (F.col("maxx") >= x1) & (F.col("miny") <= y0) & (F.col("maxy") >= y1)
    covers = F.when(over, F.when(F.col("upright"), True).otherwise(geometry.covers_box(F.col("rings"), x0, y0, x1, y1))).otherwise(False)
    # What only touches a cell has no part in it.
    touches = whole | ((F.col("minx") < x1) & (F.col("maxx") > x0) & (F.col("miny") < y1) & (F.col("maxy") > y0))
    each = each.filter(touches).withColumn("covers", covers)
    best = F.row_number().over(Window.partitionBy(key, "cx", "cy").orderBy(F.desc("covers")))
    each = each.withColumns({"_k": best, "covered": F.max("covers").over(Window.partitionBy(key, "cx", "cy"))}).filter("not covered or _k = 1")
    box = geometry.box_ring(F.greatest("minx", x0), F.greatest("miny", y0), F.least("maxx", x1), F.least("maxy", y1))
    rings = F.when(F.col("covered") | (~within & F.col("upright")), F.array(F.when(F.col("covered"), geometry.box_ring(x0, y0, x1, y1)).otherwise(box))).when(within, F.col("rings")).otherwise(geometry._cut(F.col("rings"), geometry.box_planes(*corners)))
    return each.select(key, "cx", "cy", F.lit(0).alias("side"), F.col("_k").alias("own"), F.array(rings).alias("parts"))


def union_pieces(polygons: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy, lo, hi, l_lo, l_hi, r_lo, r_hi): the union of the polygons (geom_id, key, rings or parts) of each key."""
    whole = polygons if "parts" in polygons.columns else polygons.withColumn("parts", F.array("rings"))
    group = [key, "cx", "cy"]
    return _by_group(_in_cells(whole, key), group, lambda n, _: n > 0).select(*group, F.inline("found"))


def dissolved(polygons: DataFrame, key: str) -> DataFrame:
    """(key, parts, area) of the union of all polygons of a key; parts do not overlap, and the result is as large as a key's union."""
    return as_parts(union_pieces(polygons, key), [key])


def boundary(found: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1): the boundary of the union of pieces, holes included.

    Slanted sides of pieces are boundary; level and upright ones are where one piece ends and no other begins: entries and exits
    along each line are added up, and cancel where two pieces meet.
    """
    flat = lambda axis, at, lo, hi, sign: F.struct(F.lit(axis).alias("axis"), F.col(at).alias("at"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.lit(sign).alias("sign"))
    sides = F.array(flat("y", "lo", "l_lo", "r_lo", 1), flat("y", "hi", "l_hi", "r_hi", -1), flat("x", "l_lo", "lo", "hi", 1), flat("x", "r_lo", "lo", "hi", -1))
    upright = {"x": F.when(F.col("s.sign") > 0, F.col("l_lo") == F.col("l_hi")).otherwise(F.col("r_lo") == F.col("r_hi"))}
    lines = found.select(key, "l_lo", "l_hi", "r_lo", "r_hi", F.explode(sides).alias("s")).filter((F.col("s.axis") == "y") | upright["x"]).filter("s.lo < s.hi").select(key, "s.*")
    ends = lines.select(key, "axis", "at", F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.col("sign").alias("step")), F.struct(F.col("hi").alias("pos"), (-F.col("sign")).alias("step")))).alias("e"))
    ends = ends.groupBy(key, "axis", "at", F.col("e.pos").alias("pos")).agg(F.sum("e.step").alias("step")).filter("step <> 0")
    along = Window.partitionBy(key, "axis", "at").orderBy("pos")
    ends = ends.withColumns({"net": F.sum("step").over(along), "end": F.lead("pos").over(along)}).filter((F.col("net") != 0) & (F.col("end") - F.col("pos") > THIN * F.greatest(F.abs("end"), F.abs("pos"))))
    level = F.col("axis") == "y"
    pick = lambda a, b: F.when(level, F.col(a)).otherwise(F.col(b))
    flat_rows = ends.select(key, pick("pos", "at").alias("x0"), pick("at", "pos").alias("y0"), pick("end", "at").alias("x1"), pick("at", "end").alias("y1"))
    slanted = found.select(key, F.explode(F.array(F.struct(F.col("l_lo").alias("x0"), F.col("lo").alias("y0"), F.col("l_hi").alias("x1"), F.col("hi").alias("y1")), F.struct(F.col("r_lo").alias("x0"), F.col("lo").alias("y0"), F.col("r_hi").alias("x1"), F.col("hi").alias("y1")))).alias("s")).select(key, "s.*").filter("x0 <> x1")
    return flat_rows.unionByName(slanted)
