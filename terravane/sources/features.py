"""GeoJSON files split over tasks.

A file is cut into byte ranges. A first pass tells for each range how quotes and brackets change nesting, once for a start outside of a string and
once for one inside; windows over these small rows give the nesting at each range's start. A second pass takes the features that begin in a range, reading
on past its end where one goes further. No task holds more than a range and a feature.

Features are objects of type ``Feature`` directly in the member ``features``; their order in the file is ``geom_id``. A document without ``crs`` is
EPSG:4326. Null geometries have null type and parts; a file without features gives no rows.
Empty files are passed over, and a file that is no collection gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.sources.files import parts_of, stored
from terravane.sources.tiff import _listed, _qualified, _store

RANGE, BATCH = 32 << 20, 8 << 20
_MARK = re.compile(rb'\\.|["{}\[\]]', re.S)
_NAME = re.compile(rb'(?<!\\)"(crs|features)"\s*:\s*$')


def _skewed(f, at: int) -> int:
    """1 where the byte at a range's start is escaped by the one before it."""
    n = 0
    while at - n > 0 and f.read_at(1, at - n - 1) == b"\\":
        n += 1
    return n % 2


def nesting(data: bytes) -> tuple[int, int, int]:
    """(quotes modulo 2, change of depth from outside of a string, from inside) of bytes."""
    inside, depth = False, [0, 0]
    for m in _MARK.finditer(data):
        mark = m[0]
        if mark == b'"':
            inside = not inside
        elif len(mark) == 1:
            depth[inside] += 1 if mark in b"{[" else -1
    return int(inside), depth[0], depth[1]


def objects_in(f, size: int, at: int, end: int, inside: bool, depth: int) -> Iterator[tuple[int, int, bool | None, bytes]]:
    """(depth, place, whether in ``features``, bytes) of the object crs and of those of depth 2 that begin in [at, end), and depth 0 for each member that opens.

    ``depth`` counts the brackets open at ``at``. Whether an object is in ``features`` is None where its member opened before ``at``.
    """
    skip = _skewed(f, at)
    at += skip
    data = f.read_at(max(end - at, 0), at)
    start, level, inner, pos = None, None, None, 0
    while True:
        for m in _MARK.finditer(data, pos):
            mark, pos = m[0], m.end()
            if mark == b'"':
                inside = not inside
            elif inside or len(mark) > 1:
                continue
            elif mark in b"{[":
                if depth == 1:
                    lead = min(64, at + m.start())
                    name = _NAME.search(f.read_at(lead, at + m.start() - lead))
                    inner = bool(name) and name[1] == b"features" and mark == b"["
                    yield 0, at + m.start(), inner, b""
                    if name and name[1] == b"crs" and mark == b"{":
                        start, level = m.start(), 1
                elif depth == 2 and mark == b"{" and start is None and at + m.start() < end:
                    start, level = m.start(), 2
                depth += 1
            else:
                depth -= 1
                if start is not None and depth == level:
                    yield level, at + start, inner, data[start : m.end()]
                    start = None
                    if at + m.end() >= end:
                        return
        if start is None or at + len(data) >= size:
            return
        # The object goes on beyond what is read; a last lone escape is looked at again.
        more = f.read_at(min(RANGE, size - at - len(data)), at + len(data))
        data = data[start:] + more
        at, pos, start = at + start, max(pos - start, 0), 0


def split_geojson(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """Features as ``files.geojson`` gives them, of files of any length, with the file's name as ``path``."""
    where, step = _qualified(spark, path), size or RANGE
    names = _listed(where)
    files = spark.createDataFrame(names, "path string, size long").filter("size > 0")
    # A fixed number of tasks: small rows stand for much reading, so they must not be put together by their size.
    tasks = max(min(sum(-(-b // step) for _, b in names), 4 * spark.sparkContext.defaultParallelism), 1)
    ranges = files.withColumn("n", F.explode(F.expr(f"sequence(0L, (size - 1) div {step})"))).repartition(tasks, "path", "n")

    def depths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs = _store(where)[0]
        for frame in frames:
            for name, length, n in zip(frame["path"], frame["size"], frame["n"]):
                with fs.open_input_file(name) as f:
                    at = int(n) * step
                    skip = _skewed(f, at)
                    # A mark that the next range's first byte would belong to is skipped there, so it counts nowhere.
                    yield pd.DataFrame([(name, length, n, *nesting(f.read_at(max(min(step, int(length) - at) - skip, 0), at + skip)))], columns=["path", "size", "n", "odd", "out", "within"])

    marks = stored(ranges.mapInPandas(depths, "path string, size long, n long, odd int, out int, within int"), "nesting")
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    states = marks.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    states = states.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("within"))).over(before), F.lit(0)))

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs = _store(where)[0]
        for frame in frames:
            for name, length, n, inside, depth in zip(frame["path"], frame["size"], frame["n"], frame["inside"], frame["depth"]):
                with fs.open_input_file(name) as f:
                    rows, held = [], 0
                    for level, start, inner, text in objects_in(f, int(length), int(n) * step, min(int(n) * step + step, int(length)), bool(inside), int(depth)):
                        rows.append((name, n, start, level, inner, text.decode()))
                        held += len(text)
                        if held > BATCH:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["path", "n", "place", "level", "inner", "value"]
    placed = states.select("path", "size", "n", "inside", "depth").repartition(tasks, "path", "n").mapInPandas(take, "path string, n long, place long, level int, inner boolean, value string")
    kind = F.get_json_object("value", "$.type")
    seen = stored(placed.filter((F.col("level") < 2) | (kind == "Feature")), "features")
    # Objects before the first member of their range are in the one that opened last in the ranges before.
    opened = marks.select("path", "n").join(seen.filter("level = 0").groupBy("path", "n").agg(F.max_by("inner", "place").alias("last")), ["path", "n"], "left")
    opened = opened.select("path", "n", F.last("last", True).over(before).alias("held"))
    found = seen.filter("level > 0").join(opened, ["path", "n"]).filter((F.col("level") == 1) | F.coalesce("inner", "held"))
    counts = found.filter("level = 2").groupBy("path", "n").agg(F.count("*").alias("c"))
    first = counts.select("path", "n", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    named = found.filter("level = 1").groupBy("path").agg(F.max(F.get_json_object("value", "$.properties.name")).alias("named"))
    f = F.from_json("value", "struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>")
    k = F.row_number().over(Window.partitionBy("path", "n").orderBy("place")) - 1
    rows = found.filter("level = 2").withColumn("k", k).join(first, ["path", "n"]).join(named, "path", "left").withColumn("f", f)
    return rows.select(F.concat(F.lit(_store(where)[2]), "path").alias("path"), (F.col("first") + F.col("k")).alias("geom_id"), F.col("f.geometry.type").alias("geom_type"), parts_of(F.col("f.geometry")).alias("parts"), F.coalesce("named", F.lit("EPSG:4326")).alias("crs"), F.col("f.properties").alias("props"))
