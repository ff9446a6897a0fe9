"""Scene, band and mask file names; manifests; catalogue predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCENE = r"^(S2[A-C])_MSIL2A_([0-9]{8}T[0-9]{6})_N([0-9]{4})_R([0-9]{3})_T([0-9]{2})([A-Z]{3})_([0-9]{8}T[0-9]{6})\.SAFE$"
RASTER = r"^T([0-9]{2}[A-Z]{3})_([0-9]{8}T[0-9]{6})_([A-Z0-9]{3})_([0-9]{2})m\.jp2$"
FOOTPRINT = r"^MSK_DETFOO_([A-Z0-9]{3})\.jp2$"
REGION = r"NHDPLUS_H_([0-9]{4})_HU4(?:_[0-9]{8})?_RASTER\.zip$"
#: Bands that the vegetation index needs, with their resolution in metres.
NDVI_BANDS = {"B04": 10, "B08": 10, "SCL": 20}


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def scene(name: Column) -> Column:
    """Tile, datatake, zone and reference system of a scene name; fields are null for other names."""
    zone = _part(name, SCENE, 5)
    return F.struct(
        F.concat(zone, _part(name, SCENE, 6)).alias("tile_id"), _part(name, SCENE, 2).alias("datatake"), _part(name, SCENE, 4).cast("int").alias("orbit"),
        zone.cast("int").alias("utm_zone"), F.concat(F.lit("EPSG:326"), zone).alias("crs"),
    )


def raster(name: Column) -> Column:
    """Tile, datatake, band and resolution of a band's file name."""
    return F.struct(_part(name, RASTER, 1).alias("tile_id"), _part(name, RASTER, 2).alias("datatake"), _part(name, RASTER, 3).alias("band"), _part(name, RASTER, 4).cast("int").alias("resolution"))


def footprint_band(name: Column) -> Column:
    """Band of a detector footprint mask."""
    return _part(name, FOOTPRINT, 1)


def ndvi_band(band: Column) -> Column:
    """The band, or an error for one that the vegetation index does not use."""
    return F.when(band.isin(*NDVI_BANDS), band).otherwise(F.raise_error(F.concat(F.lit("not a vegetation band: "), band)))


def manifest_hrefs(manifests: DataFrame) -> DataFrame:
    """(scene_key, href) of every file location of manifests (scene_key, xml), joined to the scene and normalised."""
    hrefs = manifests.select("scene_key", F.explode(F.expr("xpath(xml, '//fileLocation/@href')")).alias("href"))
    return hrefs.select("scene_key", F.concat(F.regexp_replace("scene_key", "/+$", ""), F.lit("/"), F.regexp_replace("href", r"^(?:\./)+", "")).alias("key"))


def wanted_keys(keys: DataFrame, bands: dict[str, int] | None = None) -> DataFrame:
    """Keys of band rasters in the wanted resolution and of footprint masks of those bands."""
    bands = bands or NDVI_BANDS
    name = F.element_at(F.split("key", "/"), -1)
    r, mask = raster(name), footprint_band(name)
    is_band = F.coalesce(*(F.when((r["band"] == b) & (r["resolution"] == m), F.lit(True)) for b, m in bands.items()), F.lit(False))
    return keys.filter(is_band | F.coalesce(mask.isin(*bands), F.lit(False)))


def month_scenes(scenes: DataFrame, year: int, month: int, limit: int | None = 100) -> DataFrame:
    """Scenes of a month: from its first day to 0:00 of its last (S19, P32, Q7); a full page of ``limit`` rows raises."""
    if not 1 <= month <= 12:
        raise ValueError(f"no month {month}")
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    out = scenes.filter((F.col("start") >= first.cast("timestamp")) & (F.col("end") <= F.last_day(first).cast("timestamp")))
    if limit is not None and len(out.select(F.lit(1)).head(limit)) >= limit:
        raise ValueError(f"the search reached its page of {limit} scenes")
    return out


def newest_archives(keys: DataFrame) -> DataFrame:
    """(hu4, key) of regional raster archives; of several the last key in listing order counts."""
    code = _part(F.col("key"), REGION, 1)
    return keys.filter(F.col("key").endswith(".zip")).withColumn("hu4", code).filter("hu4 is not null").groupBy("hu4").agg(F.max_by("key", "ord").alias("key"))
