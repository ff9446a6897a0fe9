"""Readers and writers: GeoJSON, zipped members, DBF side tables, manifests, pixel tables.

Zipped and DBF files are read by ``binaryFile`` and decoded by Arrow batches, so any Hadoop file system works. Rasters: ``sources/tiff.py``.
"""

from __future__ import annotations

import atexit
import io
import re
import struct
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POSITION = "array<array<array<array<double>>>>"
_TYPES = {2: "s", 3: "H", 4: "I", 12: "d"}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the place that ``spark.checkpoint.dir`` names; on one machine a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
    path = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


@atexit.register
def _clear() -> None:
    """Delete the scratch folders of this program."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _SCRATCH:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may have gone already
            _SCRATCH.clear()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again, so that what reads it several times has it worked out once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by a key over four tasks a core: a small file of one row group is one task, whatever each of its rows costs."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def parts_of(geometry: Column) -> Column:
    """Polygons of rings of points of a GeoJSON geometry (type, coordinates as text)."""
    coordinates, kind = geometry["coordinates"], geometry["type"]
    nested = F.when(kind == "MultiPolygon", coordinates).when(kind == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]"))).otherwise(F.concat(F.lit("[[["), coordinates, F.lit("]]]")))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return F.transform(F.from_json(nested, _POSITION), lambda poly: F.transform(poly, lambda ring: F.transform(ring, point)))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as (geom_id, geom_type, parts, crs, props); parts: polygons of rings of points; no crs member is EPSG:4326."""
    kind = "struct<crs:struct<properties:struct<name:string>>,features:array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", kind).alias("d")).select(F.coalesce("d.crs.properties.name", F.lit("EPSG:4326")).alias("crs"), F.posexplode("d.features").alias("geom_id", "f"))
    return doc.select(F.col("geom_id").cast("long").alias("geom_id"), F.col("f.geometry.type").alias("geom_type"), parts_of(F.col("f.geometry")).alias("parts"), "crs", F.col("f.properties").alias("props"))


def features_in(vectors: DataFrame, minx: float, miny: float, maxx: float, maxy: float, columns: list[str]) -> DataFrame:
    """Features whose stored extent meets a box; both filter and columns reach the scan."""
    return vectors.filter((F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)).select(*columns)


def zip_member(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(path, name, content) of the one member of each archive with a base name; none or several raise."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for where, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.rsplit("/", 1)[-1] == member]
                    if len(names) != 1:
                        raise ValueError(f"{len(names)} members named {member} in {where}")
                    out.append((where, names[0], z.read(names[0])))
            yield pd.DataFrame(out, columns=["path", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(find, "path string, name string, content binary")


def dbf_rows(content: bytes) -> list[dict[str, str]]:
    """Records of a DBF file as text, deleted ones left out."""
    count, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32
    out = []
    for i in range(count):
        record, at = content[head + i * size : head + (i + 1) * size], 1
        if record[:1] == b"*":
            continue
        row = {}
        for name, width in fields:
            row[name] = record[at : at + width].decode("latin-1").strip()
            at += width
        out.append(row)
    return out


def count_tables(archives: DataFrame) -> DataFrame:
    """(archive, value, count) of side tables (path, content); numbers may be in scientific notation."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for where, content in zip(frame["path"], frame["content"]):
                for r in dbf_rows(content):
                    low = {k.lower(): v for k, v in r.items()}
                    rows.append((where, int(float(low["value"])), int(float(low["count"]))))
            yield pd.DataFrame(rows, columns=["archive", "value", "count"])

    return archives.select("path", "content").mapInPandas(read, "archive string, value long, count long")


def write_tiff(pixels: np.ndarray, meta: dict, nodata: float = -9999.0) -> bytes:
    """A float64, deflated, one-strip-per-band TIFF of (bands, rows, columns) pixels; NaN becomes nodata; for small rasters in memory."""
    bands, height, width = pixels.shape
    strips = [zlib.compress(np.where(np.isnan(b), nodata, b).astype("<f8").tobytes()) for b in pixels]
    code = int(str(meta.get("crs") or "EPSG:4326").rsplit(":", 1)[-1])
    geographic = code in (4326, 4269)
    keys = [1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, code]
    text = f"{nodata:g}".encode() + b"\0"
    entries = [
        (256, 4, [width]), (257, 4, [height]), (258, 3, [64] * bands), (259, 3, [8]), (262, 3, [1]), (273, 4, None), (277, 3, [bands]), (278, 4, [height]),
        (279, 4, [len(s) for s in strips]), (284, 3, [2]), (339, 3, [3] * bands), (33550, 12, [meta["a"], -meta["e"], 0.0]), (33922, 12, [0.0, 0.0, 0.0, meta["c"], meta["f"], 0.0]), (34735, 3, keys), (42113, 2, text),
    ]
    head = 8 + 2 + 12 * len(entries) + 4
    sizes = [len(v) if k == 2 else struct.calcsize(_TYPES[k]) * len(v if v is not None else strips) for _, k, v in entries]
    where, at = [], head
    for s in sizes:
        where.append(at)
        at += s + s % 2 if s > 4 else 0
    starts = []
    for s in strips:
        starts.append(at)
        at += len(s)
    entries = [(t, k, starts if v is None else v) for t, k, v in entries]
    out = io.BytesIO()
    out.write(struct.pack("<2sHIH", b"II", 42, 8, len(entries)))
    late = []
    for (tag, kind, v), size, w in zip(entries, sizes, where):
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{_TYPES[kind]}", *v)
        out.write(struct.pack("<HHI", tag, kind, len(v)) + (raw.ljust(4, b"\0") if size <= 4 else struct.pack("<I", w)))
        if size > 4:
            late.append(raw + b"\0" * (size % 2))
    out.write(struct.pack("<I", 0) + b"".join(late) + b"".join(strips))
    return out.getvalue()


def save_pixels(pixels: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Pixel tables at rest: chunks of 512 x 512 cells side by side, so that window filters skip row groups."""
    rows = pixels.withColumns({"brow": F.expr("row div 512"), "bcol": F.expr("col div 512")})
    rows = rows.repartitionByRange(*[F.col(c) for c in [*(by or []), "brow", "bcol"]]).sortWithinPartitions("brow", "bcol", "row", "col")
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def load_window(spark: SparkSession, path: str, row: tuple[int, int], col: tuple[int, int]) -> DataFrame:
    """Cells of a saved pixel table within inclusive ranges."""
    near = (F.col("brow").between(row[0] // 512, row[1] // 512)) & (F.col("bcol").between(col[0] // 512, col[1] // 512))
    return spark.read.parquet(path).filter(near & F.col("row").between(*row) & F.col("col").between(*col)).drop("brow", "bcol")
