"""Depth layers, unit cleanup, carbon stock and reflectance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Depth layers in cm (fixed values).
LAYERS = ((0, 5), (5, 15), (15, 30), (30, 60), (60, 100), (100, 200))
OM_TO_SOC = 0.58
HALF_WIDTH = 1.645
CLOUDS = (3, 8, 9, 10)
#: Flow direction codes (fixed values).
FLOW = {0: "SINK", 1: "E", 2: "SE", 4: "S", 8: "SW", 16: "W", 32: "NW", 64: "N", 128: "NE"}


def layers_between(start: int, end: int) -> list[tuple[int, int]]:
    """Whole layers from a layer's start to a layer's end."""
    if start not in {a for a, _ in LAYERS} or end not in {b for _, b in LAYERS} or end <= start:
        raise ValueError(f"no layers from {start} to {end}")
    return [(a, b) for a, b in LAYERS if a >= start and b <= end]


def layers_including(start: int, end: int) -> list[tuple[int, int]]:
    """Layers that overlap a depth range."""
    if start < 0 or end > LAYERS[-1][1] or end <= start:
        raise ValueError(f"depth range {start}-{end} is not within 0-{LAYERS[-1][1]}")
    return [(a, b) for a, b in LAYERS if start < b and end > a]


def layer_weight(start: int, end: int, top: Column, bottom: Column) -> Column:
    """Centimetres of a layer within a depth range."""
    return F.least(F.lit(end), bottom) - F.greatest(F.lit(start), top)


def cleaned(prop: str, value: Column) -> Column:
    """Linear organic matter; no negative bulk density."""
    if prop == "om":
        return F.pow(F.lit(10.0), value)
    if prop == "bd":
        return F.when(value >= 0, value)
    return value


def layer_variance(p5: Column, p95: Column) -> Column:
    """Variance of a layer from its 5 and 95 % quantiles."""
    s = (p5 - p95) / (2 * HALF_WIDTH)
    return s * s


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean over layers, null where any layer is null (A1)."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value * weight) / F.sum(weight))


def weighted_stddev(p5: Column, p95: Column, weight: Column, compat: bool = False) -> Column:
    """Aggregate: deviation of the weighted mean, with squared weights (A2).

    By default null where any layer is null; ``compat`` leaves such layers out of the numerator only.
    """
    v = layer_variance(p5, p95)
    out = F.sqrt(F.sum(weight * weight * v) / F.sum(weight * weight))
    return out if compat else F.when(F.count(v) == F.count(F.lit(1)), out)


def product_stddev(xm: Column, xs: Column, ym: Column, ys: Column) -> Column:
    """Deviation of a product of independent values."""
    return F.sqrt(xs * xs * ys * ys + xs * xs * ym * ym + ys * ys * xm * xm)


def reflectance(value: Column) -> Column:
    """Surface reflectance; 0 is missing."""
    return F.nullif(value, F.lit(0)) / 10000


def ndvi(red: Column, nir: Column) -> Column:
    """Vegetation index, null for a zero sum."""
    return F.try_divide(nir - red, nir + red)


def clear(scene_class: Column, value: Column) -> Column:
    """Value outside clouds; a pixel without a class stays."""
    return F.when(~F.coalesce(scene_class, F.lit(0)).isin(*CLOUDS), value)


def valid(value: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(value), value)


def flow_direction(code: Column, strict: bool = False) -> Column:
    """Name of a flow direction; unknown and null codes raise if ``strict``."""
    table = F.create_map(*(F.lit(x) for pair in FLOW.items() for x in pair))
    name = F.try_element_at(table, code.cast("int"))
    return F.coalesce(name, F.raise_error(F.lit("unknown flow direction"))) if strict else name
