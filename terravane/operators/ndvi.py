"""Vegetation index: datatake mosaics and monthly statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import soil_math

STATS = ("mean", "min", "max", "stddev")


def footprint_masked(pixels: DataFrame, footprints: DataFrame) -> DataFrame:
    """Band pixels (datatake, tile_id, band, row, col, value) outside their band's footprint become null; bands without one stay (P20, Q12)."""
    keys = ["datatake", "tile_id", "band"]
    has = footprints.select(*keys).distinct().withColumn("_has", F.lit(True))
    inside = footprints.filter("value is not null").select(*keys, "row", "col", F.lit(True).alias("_in"))
    out = pixels.join(has, keys, "left").join(inside, [*keys, "row", "col"], "left")
    return out.withColumn("value", F.when(F.col("_has").isNull() | F.col("_in"), F.col("value"))).drop("_has", "_in")


def datatake_index(pixels: DataFrame) -> DataFrame:
    """Index by crs, datatake and 10 m cell, from (crs, datatake, source_ord, band, row, col, value).

    Tiles of a datatake merge by their first valid value.  A 20 m class and the four 10 m cells below it meet in one
    aggregation, so no pixel is copied before the shuffle.
    """
    coarse = F.col("band") == "SCL"
    block = [F.when(coarse, F.col(k)).otherwise(F.expr(f"{k} div 2")).alias(f"b{k}") for k in ("row", "col")]
    slot = F.when(~coarse, (F.col("row") % 2) * 2 + F.col("col") % 2).alias("slot")
    rows = pixels.select("crs", "datatake", *block, slot, "source_ord", "band", "value")

    def first(band: str, place: int | None) -> Column:
        here = F.col("band") == band if place is None else (F.col("band") == band) & (F.col("slot") == place)
        return F.min_by(F.when(here, F.col("value")), F.when(here & F.col("value").isNotNull(), F.col("source_ord")))

    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.max((F.col("band") == "B04") & (F.col("slot") == i * 2 + j)).alias("seen"), first("B04", i * 2 + j).alias("red"), first("B08", i * 2 + j).alias("nir")) for i in (0, 1) for j in (0, 1)]
    cell = rows.groupBy("crs", "datatake", "brow", "bcol").agg(first("SCL", None).alias("scl"), F.array(*cells).alias("cells"))
    cell = cell.select("crs", "datatake", "brow", "bcol", "scl", F.explode(F.filter("cells", lambda c: c["seen"])).alias("c"))
    red, nir = (soil_math.reflectance(soil_math.clear(F.col("scl"), F.col(f"c.{b}"))) for b in ("red", "nir"))
    return cell.select("crs", "datatake", (F.col("brow") * 2 + F.col("c.i")).alias("row"), (F.col("bcol") * 2 + F.col("c.j")).alias("col"), soil_math.ndvi(red, nir).alias("value"))


def monthly(index: DataFrame, statistics: tuple[str, ...] = STATS) -> DataFrame:
    """Statistics over datatakes of every cell (A11, A12); stddev needs mean."""
    if "stddev" in statistics and "mean" not in statistics:
        raise ValueError("stddev needs mean")
    by = {"mean": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop}
    return index.groupBy("crs", "row", "col").agg(*(by[s]("value").alias(s) for s in statistics))
