"""Shared helpers: tables, the cluster's shared folder, and vectorised text access.

Intermediate results that cut lineage are Parquet tables below the folder named by
``spark.checkpoint.dir`` (shared by driver and executors), so that a lost executor
costs a task retry and nothing else.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch: whole texts travel in them, so a batch stays small.
BATCH_ROWS = 512

_TABLES: list[str] = []
_SCOPES: dict[str, list[str]] = {}
_OPEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the plans that are built next, and let workers import this package."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on one machine a new one where that is unset, on a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        where = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    if _OPEN:
        _SCOPES[_OPEN[-1]].append(path)
    return path


def partitions(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for a shuffle of about the rows of ``df``: the session's number, or more where they would be over ``bytes_each``.

    The size is the planner's estimate from the files, which costs no job; tables of unknown size get the session's number.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, -(-size // bytes_each))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the reread table."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, name: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    if name in _TABLES:
        _TABLES.remove(name)


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables written inside belong to ``name``; those of its last use are deleted on entry."""
    for path in _SCOPES.pop(name, []):
        delete(spark, path)
    _SCOPES[name] = []
    _OPEN.append(name)
    try:
        yield
    finally:
        _OPEN.pop()


def release(spark: SparkSession) -> None:
    """Delete the tables written so far.  Call only when nothing that reads them is still to run."""
    for path in list(_TABLES):
        delete(spark, path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _TABLES:
        try:
            release(spark)
        except Exception:  # the JVM may have gone already
            _TABLES.clear()


atexit.register(_at_exit)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying a text; nulls have length 0."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


#: ASCII white space: space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finaliser of splitmix64, a fixed value)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POW: np.ndarray = np.ones(1, np.uint64)
_INV: np.ndarray = np.ones(1, np.uint64)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, 1 << 16)
        steps = np.full(m, _B, np.uint64)
        steps[0] = 1
        _POW = np.multiply.accumulate(steps)
        steps = np.full(m, _BINV, np.uint64)
        steps[0] = 1
        _INV = np.multiply.accumulate(steps)
    return _POW, _INV


def words(off: np.ndarray, raw: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text of a batch: (64-bit hash, start byte, end byte, first word index of each text + total).

    A word is a maximal run of bytes that are not ASCII white space (or of bytes flagged in
    ``is_word``); equal hashes of unequal words occur with probability 2**-64 a pair.
    """
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[raw] if is_word is None else is_word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return h, start, end, np.searchsorted(start, off)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (len(h) - k + 1 of them)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(m, np.uint64)
    for j in range(k):
        g = g * _B + h[j : j + m]
    return mix(g)


def as_batches(columns: dict[str, np.ndarray | list | pa.Array], schema: pa.Schema, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    out = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
    for i in range(0, out.num_rows, rows):
        yield out.slice(i, rows)
