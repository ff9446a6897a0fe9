"""TIFF rasters as a Python data source: window reads by byte ranges and tiled writes.

``spark.read.format("tiff").load(path)`` gives one row a cell (``content=meta``: one row of metadata a file). The driver lists names and
sizes only. A partition is a share of a file's blocks, or several small files; a task reads the header and then those blocks that meet the window, so a
small window of a large file costs a few ranges. The window comes from the options ``rows``, ``cols``, ``bands`` ("first,last") and ``bounds``
("left,bottom,right,top"), or from filters on ``raster_id``, ``row``, ``col`` and ``band`` with the option
``filters=true`` (set by ``tiff_pixels`` where ``spark.sql.python.filterPushdown.enabled`` is on, without which Spark refuses it); Spark applies filters again,
so they only spare reads.

``write_tiffs`` deflates the tiles of all rasters in tasks; a raster's file is then one stream of finished tiles behind their header, never a whole raster in
memory. Files are written below ``_temporary`` and moved by the commit; an abort deletes them. Tiles without values share one blank tile. Files beyond
4 GB have 64-bit offsets.

Nodata and NaN are null. A cell that comes several times keeps its largest value; null rows, columns or bands, cells beyond the raster and rasters without
metadata raise. A raster without cells becomes a file of one blank band. Other columns are ignored.
"""

from __future__ import annotations

import fnmatch
import math
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

PIXELS = "raster_id string, band int, row long, col long, value double"
META = "raster_id string, a double, b double, c double, d double, e double, f double, height long, width long, bands int, crs string"
_FILE = "raster_id string, band int, trow long, tcol long, content binary"
_PIXEL_TYPE = pa.schema([("raster_id", pa.string()), ("band", pa.int32()), ("row", pa.int64()), ("col", pa.int64()), ("value", pa.float64())])

# Fixed values of the format: struct codes of field types.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}

# Bytes of files that one partition takes, and the least that a file counts for.
SHARE, LEAST = 64 << 20, 1 << 20
# Rows of a block that go to Spark at once.
SLICE = 512

Fetch = Callable[[int, int], bytes]


class Tiff:
    """Header of a TIFF, read through ``fetch(offset, size)``: strips or tiles, plain or deflate, chunky or planar."""

    def __init__(self, fetch: Fetch):
        self.fetch = fetch
        head = fetch(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack_from(f"{self.order}H", head, 2)[0] if self.order else None
        if kind not in (42, 43):
            raise ValueError("no TIFF file")
        tags = self._tags(head, kind == 43)
        self.width, self.height, self.bands = tags[256][0], tags[257][0], tags.get(277, [1])[0]
        self.deflated = tags.get(259, [1])[0]
        if self.deflated not in (1, 8, 32946):
            raise ValueError(f"unsupported TIFF compression {self.deflated}")
        self.differences = tags.get(317, [1])[0] == 2
        self.planar = tags.get(284, [1])[0] == 2
        self.dtype = np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]] + str(tags.get(258, [1])[0] // 8))
        self.tiled = 324 in tags
        self.tw, self.th = (tags[322][0], tags[323][0]) if self.tiled else (self.width, min(tags.get(278, [self.height])[0], self.height))
        self.offsets, self.sizes = (tags[324], tags[325]) if self.tiled else (tags[273], tags[279])
        self.nodata = _nodata(tags[42113], self.dtype) if 42113 in tags else None
        self.meta = {**_affine(tags), "height": self.height, "width": self.width, "bands": self.bands, "crs": _crs(tags)}

    def _tags(self, head: bytes, big: bool) -> dict:
        order, word, count, entry, room = (self.order, "Q", "Q", 20, 8) if big else (self.order, "I", "H", 12, 4)
        at = struct.unpack_from(order + word, head, 8 if big else 4)[0]
        lead = struct.calcsize("=" + count)
        n = struct.unpack(order + count, self.fetch(at, lead))[0]
        rows = self.fetch(at + lead, n * entry)
        tags = {}
        for i in range(n):
            tag, kind, m = struct.unpack_from(f"{order}HH{word}", rows, i * entry)
            code = _TYPES.get(kind)
            if code is None:
                continue
            size = struct.calcsize("=" + code) * m
            pos = i * entry + entry - room
            raw = rows[pos : pos + size] if size <= room else self.fetch(struct.unpack_from(order + word, rows, pos)[0], size)
            tags[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(f"{order}{m}{code}", raw)
        return tags

    def window(self, bounds: tuple[float, float, float, float]) -> tuple[tuple[int, int], tuple[int, int]]:
        """First and last row and column of a window: floor at the upper left corner, ceil at the lower right, which is left out."""
        left, bottom, right, top = bounds
        m = self.meta
        whole = m["a"] * m["e"] - m["b"] * m["d"]
        place = lambda x, y: ((m["a"] * (y - m["f"]) - m["d"] * (x - m["c"])) / whole, (m["e"] * (x - m["c"]) - m["b"] * (y - m["f"])) / whole)
        (r0, c0), (r1, c1) = place(left, top), place(right, bottom)
        return (math.floor(r0), math.ceil(r1) - 1), (math.floor(c0), math.ceil(c1) - 1)

    def blocks(self, rows: tuple[int, int], cols: tuple[int, int], bands: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
        """(number, first band, first row, first column) of the blocks that meet inclusive ranges."""
        across, down = -(-self.width // self.tw), -(-self.height // self.th)
        r0, r1, c0, c1 = max(rows[0], 0), min(rows[1], self.height - 1), max(cols[0], 0), min(cols[1], self.width - 1)
        b0, b1 = max(bands[0], 1), min(bands[1], self.bands)
        if r0 > r1 or c0 > c1 or b0 > b1:
            return
        for band in range(b0, b1 + 1) if self.planar else (1,):
            for y in range(r0 // self.th, r1 // self.th + 1):
                for x in range(c0 // self.tw, c1 // self.tw + 1):
                    yield ((band - 1) * down + y) * across + x, band, y * self.th, x * self.tw

    def values(self, number: int, top: int, left: int) -> np.ndarray:
        """Cells (bands of the block, rows, columns) as doubles, NaN where nodata; padding is cut off. A block of no bytes is nodata."""
        rows = self.th if self.tiled else min(self.th, self.height - top)
        deep = 1 if self.planar else self.bands
        h, w = min(rows, self.height - top), min(self.tw, self.width - left)
        if not self.sizes[number]:
            return np.full((deep, h, w), np.nan if self.nodata is not None else 0.0)
        raw = self.fetch(self.offsets[number], self.sizes[number])
        cells = np.frombuffer(raw if self.deflated == 1 else zlib.decompress(raw), self.dtype, rows * self.tw * deep).reshape(rows, self.tw, deep)
        if self.differences:
            cells = np.cumsum(cells, axis=1, dtype=self.dtype)
        cells = cells[:h, :w].transpose(2, 0, 1)
        out = cells.astype(float)
        if self.nodata is not None:
            out[cells == self.nodata] = np.nan
        return out


def _nodata(text: str, dtype: np.dtype) -> np.generic | None:
    """The value that stands for nodata, None where cells of the type cannot have it."""
    value = float(text)
    if dtype.kind != "f" and not (value.is_integer() and np.iinfo(dtype).min <= value <= np.iinfo(dtype).max):
        return None
    return dtype.type(value)


def _affine(tags: dict) -> dict:
    keys = tags.get(34735, ())
    if 34264 in tags:
        t = tags[34264]
        out = {"a": t[0], "b": t[1], "c": t[3], "d": t[4], "e": t[5], "f": t[7]}
    else:
        scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
        out = {"a": scale[0], "b": 0.0, "c": tie[3] - tie[0] * scale[0], "d": 0.0, "e": -scale[1], "f": tie[4] + tie[1] * scale[1]}
    if any(keys[i] == 1025 and keys[i + 3] == 2 for i in range(4, len(keys) - 3, 4)):
        # Places of this kind are the cells' centres.
        out["c"] -= (out["a"] + out["b"]) / 2
        out["f"] -= (out["d"] + out["e"]) / 2
    return out


def _crs(tags: dict) -> str | None:
    keys = tags.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    code = codes.get(3072) or codes.get(2048)
    return f"EPSG:{code}" if code else None


def read_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """Pixels (bands, rows, columns; NaN where nodata) and metadata of a whole file in memory."""
    t = Tiff(lambda at, size: data[at : at + size])
    out = np.empty((t.bands, t.height, t.width))
    for number, band, top, left in t.blocks((0, t.height - 1), (0, t.width - 1), (1, t.bands)):
        part = t.values(number, top, left)
        out[band - 1 : band - 1 + len(part), top : top + part.shape[1], left : left + part.shape[2]] = part
    return out, t.meta


def _store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it and what names begin with, of a Hadoop path or a plain local one."""
    found = urllib.parse.urlparse(path)
    if found.scheme in ("", "file"):
        return pafs.LocalFileSystem(), (found.path if found.scheme else path).rstrip("/"), "file:"
    scheme = {"s3a": "s3", "s3n": "s3"}.get(found.scheme, found.scheme)
    fs, _ = pafs.FileSystem.from_uri(f"{scheme}://{found.netloc}/")
    bucket = scheme in ("s3", "gs", "gcs")
    return fs, (found.netloc + found.path if bucket else found.path).rstrip("/"), f"{found.scheme}://" + ("" if bucket else found.netloc)


def _listed(path: str) -> list[tuple[str, int]]:
    """(name, size) of a file, of all files below a folder, or of those that a pattern in the last part names; hidden ones are left out."""
    fs, at, _ = _store(path)
    folder, _, last = at.rpartition("/")
    if any(c in last for c in "*?["):
        return sorted((i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(folder)) if i.is_file and fnmatch.fnmatchcase(i.base_name, last))
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(at, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((i.path, i.size) for i in found if i.is_file and not any(p[0] in "._" for p in i.path[len(at) + 1 :].split("/")))


@dataclass
class Share(InputPartition):
    """Files as (name, share, number of shares)."""

    files: list[tuple[str, int, int]]


def _range(text: str | None, least: int) -> tuple[int, int]:
    return tuple(int(x) for x in text.split(",")) if text else (least, 1 << 62)


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.meta = options.get("content", "cells") == "meta"
        self.bounds = tuple(float(x) for x in options["bounds"].split(",")) if options.get("bounds") else None
        self.ranges = {"row": _range(options.get("rows"), 0), "col": _range(options.get("cols"), 0), "band": _range(options.get("bands"), 1)}
        self.only: str | None = None

    def partitions(self) -> list[Share]:
        lead, out, held = _store(self.path)[2], [], []
        room = SHARE
        for name, size in _listed(self.path):
            if self.only is not None and lead + name != self.only:
                continue
            if not self.meta and size > SHARE:
                shares = -(-size // SHARE)
                out += [Share([(name, i, shares)]) for i in range(shares)]
                continue
            if held and room < max(size, LEAST):
                out.append(Share(held))
                held, room = [], SHARE
            held.append((name, 0, 1))
            room -= LEAST if self.meta else max(size, LEAST)
        return out + ([Share(held)] if held else []) or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple | pa.RecordBatch]:
        fs, _, lead = _store(self.path)
        for name, share, shares in partition.files:
            with fs.open_input_file(name) as f:
                tiff = Tiff(lambda at, size, f=f: f.read_at(size, at))
                if self.meta:
                    yield (lead + name, *(tiff.meta[c] for c in "a b c d e f height width bands crs".split()))
                else:
                    yield from self.cells(tiff, lead + name, share, shares)

    def cells(self, tiff: Tiff, name: str, share: int, shares: int) -> Iterator[pa.RecordBatch]:
        """Cells of one share of a file's blocks, within the window."""
        rows, cols, bands = (self.ranges[k] for k in ("row", "col", "band"))
        if self.bounds:
            near = tiff.window(self.bounds)
            rows, cols = ((max(a[0], b[0]), min(a[1], b[1])) for a, b in zip((rows, cols), near))
        total = len(tiff.offsets)
        for number, band, top, left in tiff.blocks(rows, cols, bands):
            if not total * share // shares <= number < total * (share + 1) // shares:
                continue
            block = tiff.values(number, top, left)
            y0, y1 = max(rows[0] - top, 0), min(rows[1] - top + 1, block.shape[1])
            x0, x1 = max(cols[0] - left, 0), min(cols[1] - left + 1, block.shape[2])
            for b, plane in enumerate(block, band):
                if not bands[0] <= b <= bands[1]:
                    continue
                for y in range(y0, y1, SLICE):
                    part = plane[y : min(y + SLICE, y1), x0:x1]
                    row, col = np.indices(part.shape)
                    v = part.ravel()
                    columns = [pa.array([name] * v.size, pa.string()), pa.array(np.full(v.size, b, np.int32)), pa.array(row.ravel() + top + y), pa.array(col.ravel() + left + x0), pa.array(v, mask=np.isnan(v))]
                    yield pa.RecordBatch.from_arrays(columns, schema=_PIXEL_TYPE)


class FilteredTiffReader(TiffReader):
    """A reader of cells that takes filters over; Spark refuses those while its setting is off."""

    def pushFilters(self, filters: list) -> list:
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            value = getattr(f, "value", None)
            if name == "raster_id" and isinstance(f, EqualTo):
                self.only = value
            elif name in self.ranges and isinstance(value, int):
                low, high = self.ranges[name]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, value - isinstance(f, LessThan))
                self.ranges[name] = (low, high)
        # All of them are applied again.
        return filters


@dataclass
class Written(WriterCommitMessage):
    """Names (temporary, final) of a task's files."""

    files: list[tuple[str, str]]


class TiffWriter(DataSourceArrowWriter):
    """Rows of ``_FILE`` in the order of a raster's file: band 0 is its header, then come its tiles."""

    def __init__(self, path: str):
        self.path = path
        self.below = f"{_store(path)[1]}/_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base, _ = _store(self.path)
        fs.create_dir(self.below, recursive=True)
        done, name, out = [], None, None
        try:
            for batch in iterator:
                content = batch.column("content")
                for i, (raster, band) in enumerate(zip(batch.column("raster_id").to_pylist(), batch.column("band").to_pylist())):
                    if band == 0:
                        if out is not None:
                            out.close()
                        name = raster
                        done.append((f"{self.below}/{uuid.uuid4().hex}", f"{base}/{urllib.parse.quote(_plain(raster), safe='/ =+-')}.tif"))
                        out = fs.open_output_stream(done[-1][0])
                    elif raster != name:
                        raise ValueError(f"no metadata of raster {raster}")
                    out.write(content[i].as_buffer())
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs = _store(self.path)[0]
        for old, new in (f for m in messages if m for f in m.files):
            fs.create_dir(new.rpartition("/")[0], recursive=True)
            fs.move(old, new)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs = _store(self.path)[0]
        if fs.get_file_info(self.below).type != pafs.FileType.NotFound:
            fs.delete_dir(self.below)


def _plain(raster: str | None) -> str:
    if not raster or any(p in ("", ".", "..") for p in raster.split("/")):
        raise ValueError(f"{raster} names no file below the folder")
    return raster


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return META if self.options.get("content") == "meta" else PIXELS

    def reader(self, schema) -> TiffReader:
        options = dict(self.options)
        return (FilteredTiffReader if options.get("filters") == "true" and options.get("content") != "meta" else TiffReader)(options)

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        if overwrite:
            raise ValueError("tiff files are added to a folder: mode append")
        return TiffWriter(self.options["path"])


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the cluster's file system where it has none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def tiff_pixels(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, bands: tuple[int, int] | None = None, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Cells of the raster files at ``path`` within inclusive ranges and bounds in each file's own system (S1, S8, D2); raster_id is the file's path."""
    spark.dataSource.register(TiffSource)
    options = {k: ",".join(map(repr, v)) for k, v in (("rows", rows), ("cols", cols), ("bands", bands), ("bounds", bounds)) if v is not None}
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("tiff").options(filters=filters, **options).load(_qualified(spark, path))


def tiff_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row of metadata for each raster file; the raster_id is its path."""
    spark.dataSource.register(TiffSource)
    return spark.read.format("tiff").option("content", "meta").load(_qualified(spark, path))


def _deflated(cells: np.ndarray, nodata: float) -> bytes:
    return zlib.compress(np.where(np.isnan(cells), nodata, cells).astype("<f8").tobytes())


def tiff_head(meta: dict, bands: int, tile: int, number: np.ndarray, size: np.ndarray, nodata: float, big: bool | None = None) -> bytes:
    """Header and blank tile of a tiled, planar, deflated float64 file, whose tiles of ``number`` (ascending) and ``size`` follow at once."""
    blank = _deflated(np.full((tile, tile), np.nan), nodata)
    count = bands * -(-meta["height"] // tile) * -(-meta["width"] // tile)
    if big is None:
        big = int(size.sum()) + len(blank) + 32 * count + (1 << 16) >= 1 << 32
    whole = 16 if big else 4
    sizes, starts = np.full(count, len(blank)), np.zeros(count, np.int64)
    sizes[number] = size
    starts[number] = len(blank) + np.cumsum(size) - size
    code = int(meta["crs"].rsplit(":", 1)[-1]) if meta.get("crs") else None
    degrees = code in (4326, 4269)
    entries = [
        (256, 4, [meta["width"]]), (257, 4, [meta["height"]]), (258, 3, [64] * bands), (259, 3, [8]), (262, 3, [1]), (277, 3, [bands]), (284, 3, [2]), (322, 4, [tile]), (323, 4, [tile]),
        (324, whole, starts), (325, whole, sizes), (339, 3, [3] * bands),
    ]
    if meta.get("b") or meta.get("d"):
        entries.append((34264, 12, [meta["a"], meta["b"], 0, meta["c"], meta["d"], meta["e"], 0, meta["f"], 0, 0, 0, 0, 0, 0, 0, 1]))
    else:
        entries += [(33550, 12, [meta["a"], -meta["e"], 0]), (33922, 12, [0, 0, 0, meta["c"], meta["f"], 0])]
    if code:
        entries.append((34735, 3, [1, 1, 0, 2, 1024, 0, 1, 2 if degrees else 1, 2048 if degrees else 3072, 0, 1, code]))
    entries.append((42113, 2, f"{nodata!r}".encode() + b"\0"))
    entries.sort(key=lambda e: e[0])
    word, room = ("Q", 8) if big else ("I", 4)
    width = {2: 1, 3: 2, 4: 4, 12: 8, 16: 8}
    lead = (16 + 8 + 20 * len(entries) + 8) if big else (8 + 2 + 12 * len(entries) + 4)
    long = [(len(v) * width[k] + 7) // 8 * 8 if len(v) * width[k] > room else 0 for _, k, v in entries]
    places = lead + np.cumsum(long) - long
    starts += lead + sum(long)
    out = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(entries)) if big else struct.pack("<2sHIH", b"II", 42, 8, len(entries))
    late = b""
    for (tag, kind, v), space, place in zip(entries, long, places):
        raw = v if kind == 2 else np.asarray(v).astype({3: "<u2", 4: "<u4", 12: "<f8", 16: "<u8"}[kind]).tobytes()
        out += struct.pack("<HH" + word, tag, kind, len(v)) + (struct.pack("<" + word, place) if space else raw.ljust(room, b"\0"))
        late += raw.ljust(space, b"\0") if space else b""
    return out + struct.pack("<" + word, 0) + late + blank


def tiled(pixels: DataFrame, tile: int, nodata: float) -> DataFrame:
    """Tiles (raster_id, band, trow, tcol, last_row, last_col, size, content) that have values, deflated in tasks, one of bounded size a group."""

    def deflate(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        row, col = frame["row"].to_numpy(), frame["col"].to_numpy()
        cells = np.full((tile, tile), np.nan)
        np.fmax.at(cells, (row % tile, col % tile), frame["value"].to_numpy())
        content = _deflated(cells, nodata)
        return pd.DataFrame([(first["raster_id"], first["band"], first["trow"], first["tcol"], row.max(), col.max(), len(content), content)], columns=["raster_id", "band", "trow", "tcol", "last_row", "last_col", "size", "content"])

    bad = F.expr("raster_id is null or band is null or row is null or col is null or band < 1 or row < 0 or col < 0")
    value = F.when(bad, F.raise_error(F.lit("a cell has no place in a raster"))).otherwise(F.col("value").cast("double"))
    cells = pixels.select(F.col("raster_id").cast("string").alias("raster_id"), F.col("band").cast("int").alias("band"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), value.alias("value"))
    cells = cells.filter("value is not null and not isnan(value)").withColumns({"trow": F.expr(f"row div {tile}"), "tcol": F.expr(f"col div {tile}")})
    return cells.groupBy("raster_id", "band", "trow", "tcol").applyInPandas(deflate, "raster_id string, band int, trow long, tcol long, last_row long, last_col long, size long, content binary")


def write_tiffs(pixels: DataFrame, meta: DataFrame, path: str, tile: int = 512, nodata: float = -9999.0, big: bool | None = None) -> None:
    """Write each raster of ``meta`` as ``path/<raster_id>.tif`` (S2, S26); the module's text states what each case gives. ``tile`` is a multiple of 16."""
    from terravane.sources.files import stored

    if tile < 16 or tile % 16:
        raise ValueError("tile is no multiple of 16")
    spark = pixels.sparkSession
    spark.dataSource.register(TiffSource)
    # Kept, as sizes are needed before the first byte of a file and contents after.
    tiles = stored(tiled(pixels, tile, nodata), "tiles")
    block = F.struct("band", "trow", "tcol", "size")
    seen = tiles.groupBy("raster_id").agg(F.sort_array(F.collect_list(block)).alias("t"), F.max("last_row").alias("last_row"), F.max("last_col").alias("last_col"))
    own = [F.col(c).cast("double").alias(c) if c in meta.columns else F.lit(0.0).alias(c) for c in "abcdef"]
    known = meta.select(F.col("raster_id").cast("string").alias("raster_id"), *own, F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), "crs")
    joined = known.join(seen, "raster_id", "left").select(*known.columns, "last_row", "last_col", *[F.col(f"t.{c}").alias(c) for c in ("band", "trow", "tcol", "size")])

    def head(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for m in frame.to_dict("records"):
                none = m["band"] is None
                band, trow, tcol, size = (np.zeros(0, np.int64) if none else np.asarray(m[c], np.int64) for c in ("band", "trow", "tcol", "size"))
                if not none and (m["last_row"] >= m["height"] or m["last_col"] >= m["width"]):
                    raise ValueError(f"cells beyond raster {m['raster_id']}")
                number = ((band - 1) * -(-m["height"] // tile) + trow) * -(-m["width"] // tile) + tcol
                content = tiff_head(m, 1 if none else int(band.max()), tile, number, size, nodata, big)
                yield pd.DataFrame([(m["raster_id"], 0, 0, 0, content)], columns=["raster_id", "band", "trow", "tcol", "content"])

    rows = joined.mapInPandas(head, _FILE).unionByName(tiles.select("raster_id", "band", "trow", "tcol", "content"))
    rows = rows.repartition("raster_id").sortWithinPartitions("raster_id", "band", "trow", "tcol")
    # Batches of 128 MB at most.
    key, held = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, str(max((128 << 20) // (8 * tile * tile), 1)))
    try:
        rows.write.format("tiff").mode("append").option("path", _qualified(spark, path)).save()
    finally:
        spark.conf.set(key, held)
