"""Exact top-k inner products by a pivot-distance index.

Vectors become integers floor(1024 x).  With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) turn
inner products into distances: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.  Every vector is keyed by its nearest pivot and
its distance to it; rows in key order are packed into segments, rings of one pivot with a least and a largest
distance.  For a pivot p at distance d of a query, no vector of a ring [a, b] is nearer than max(a - d, d - b, 0).

A query first searches the rings around its own key, which gives a score that its k-th answer reaches; then every ring
whose bound reaches that score, nearest first, and none of the others.  Answers are exact; pivots only decide how much is skipped.

Pivots are fitted on at most ``SAMPLE_ROWS`` rows.  Segments hold ``SEGMENT_ROWS`` rows, or more where that would
make over ``MAX_SEGMENTS`` of them, so the ring table that tasks hold is at most MAX_SEGMENTS rows.  Queries travel in blocks.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part, nor does a row
without vec_id; vectors are compared with those of their own length; rows with the query's vec_id count as the query's
own; ties go to the smaller vec_id; of several query rows with one vec_id one is taken; equal candidate rows all rank; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 10
PIVOTS = 32
SAMPLE_ROWS = 2_000
SEGMENT_ROWS = 2_048
MAX_SEGMENTS = 200_000
BLOCK = 256
#: Float distances are off by far less than this share of M.
SLACK = 1e-6
_SEGMENT = "segment long, dim int, pivot int, least double, most double, ids binary, vectors binary"


def integers(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 1024).cast("long"))


def usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(embedding) > 0) & fine, F.lit(False))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def to_pivots(x: np.ndarray, pivots: np.ndarray, m2: float, query: bool = False) -> np.ndarray:
    """Distances of augmented rows to augmented pivots."""
    x = x.astype(np.float64)
    n2 = (x * x).sum(1)
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(m2 - n2, 0))
    p, plast = pivots[:, :-1], pivots[:, -1]
    square = (n2 + last * last)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ p.T + last[:, None] * plast[None, :])
    return np.sqrt(np.maximum(square, 0))


def fit_pivots(sample: np.ndarray, m2: float, n: int = PIVOTS) -> np.ndarray:
    """A few rounds of k-means on augmented sample rows, from evenly spaced ones."""
    x = sample.astype(np.float64)
    x = np.concatenate([x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))[:, None]], 1)
    c = x[np.unique(np.linspace(0, len(x) - 1, min(n, len(x))).astype(int))]
    for _ in range(5):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def build_index(vectors: DataFrame, pivots: dict[int, np.ndarray], m2: dict[int, float], rows: int) -> DataFrame:
    """Segments of (vec_id, v, dim) rows, in the order of pivot and distance."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("dim", pa.int32()), ("pivot", pa.int32()), ("dist", pa.float64())])
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = matrix(part.column("v"))
                d = to_pivots(x, pivots[int(dim)], m2[int(dim)])
                near = d.argmin(1)
                raw = [r.tobytes() for r in x.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(raw, pa.binary()), pa.array(np.full(len(x), dim), pa.int32()), pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near])], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), ("least", pa.float64()), ("most", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])
        base, count, held, group = TaskContext.get().partitionId() << 32, 0, [], None

        def close() -> pa.RecordBatch:
            cells = [base + count, group[0], group[1], held[0][1], held[-1][1], np.array([h[0] for h in held], np.int64).tobytes(), b"".join(h[2] for h in held)]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

        for b in batches:
            for i, v, dim, p, d in zip(*(b.column(c).to_pylist() for c in ("vec_id", "v", "dim", "pivot", "dist"))):
                if held and ((dim, p) != group or len(held) >= rows):
                    yield close()
                    count, held = count + 1, []
                group = (dim, p)
                held.append((i, d, v))
        if held:
            yield close()

    keyed = vectors.mapInArrow(key, "vec_id long, v binary, dim int, pivot int, dist double")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartitionByRange(n, "dim", "pivot", "dist", "vec_id").sortWithinPartitions("dim", "pivot", "dist", "vec_id")
    return common.stored(keyed.mapInArrow(pack, _SEGMENT), "segments")


def _best(ids: np.ndarray, scores: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores from ``floor`` on, ties to the smaller id."""
    ok = (ids != own) & (scores >= floor)
    ids, scores = ids[ok], scores[ok]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ok = scores >= least
        ids, scores = ids[ok], scores[ok]
        order = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[order], scores[order]
    return ids, scores


def search(index: DataFrame, asked: DataFrame, m2: dict[int, float], k: int, tag: str) -> DataFrame:
    """Best answers by block and segment, (query_id, vec_id, score), for asked (segment, queries, qvectors, floors)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for b in batches:
            for dim, ids, vectors, queries, qvectors, floors in zip(*(b.column(c).to_pylist() for c in ("dim", "ids", "vectors", "queries", "qvectors", "floors"))):
                ids, queries, floors = np.frombuffer(ids, np.int64), np.frombuffer(queries, np.int64), np.frombuffer(floors)
                x, q = np.frombuffer(vectors, np.int64).reshape(len(ids), dim), np.frombuffer(qvectors, np.int64).reshape(len(queries), dim)
                # Below 2**52 sums of floats are exact integers.
                s = (q.astype(float) @ x.astype(float).T).astype(np.int64) if m2[dim] < 2**52 else q @ x.T
                got = [_best(ids, row, own, floor, k) for row, own, floor in zip(s, queries, floors)]
                yield from common.as_batches({"query_id": np.repeat(queries, [len(g[0]) for g in got]), "vec_id": np.concatenate([g[0] for g in got]), "score": np.concatenate([g[1] for g in got])}, schema)

    spark = index.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    out = common.stored(asked.join(index, "segment").select("dim", "ids", "vectors", "queries", "qvectors", "floors").mapInArrow(score, "query_id long, vec_id long, score long"), tag)
    common.prepare(spark)
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(table: DataFrame, is_query: Column, k: int = K, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the rows of (vec_id, embedding) for which ``is_query`` holds, against all rows."""
    spark = table.sparkSession
    common.prepare(spark)
    rows = table.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"), F.size("embedding").alias("dim"), is_query.alias("asks"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("m2")).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not sizes:
        return empty
    total = sum(r["n"] for r in sizes)
    m2 = {r["dim"]: float(r["m2"]) for r in sizes}
    cut = min(1.0, SAMPLE_ROWS / total)
    unit = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = sorted((r["dim"], r["vec_id"], r["v"]) for r in rows.filter(unit < cut).select("dim", "vec_id", "v").limit(2 * SAMPLE_ROWS).collect())
    pivots = {}
    for dim in m2:
        own = np.array([v for d, _, v in picked if d == dim], np.int64)
        pivots[dim] = fit_pivots(own if len(own) else np.zeros((1, dim), np.int64), m2[dim])
    index = build_index(rows.select("vec_id", "v", "dim"), pivots, m2, max(segment_rows, -(-total // MAX_SEGMENTS)))
    rings = index.select("segment", "dim", "pivot", "least", "most").collect()
    ring = {dim: tuple(np.array(c) for c in zip(*((r["segment"], r["pivot"], r["least"], r["most"]) for r in rings if r["dim"] == dim))) for dim in m2}
    shared = spark.sparkContext.broadcast((pivots, m2, ring))

    def plan(first: bool):  # noqa: ANN202
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("segment", pa.int64()), ("queries", pa.binary()), ("qvectors", pa.binary()), ("floors", pa.binary())])
            pivots, m2, ring = shared.value
            for batch in batches:
                dims = np.asarray(batch.column("dim"))
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    for at in range(0, part.num_rows, BLOCK):
                        b = part.slice(at, BLOCK)
                        q, ids = matrix(b.column("v")).astype(np.int64), np.asarray(b.column("vec_id"))
                        floors = np.full(len(ids), -np.inf) if first else np.array([-np.inf if f is None else f for f in b.column("floor").to_pylist()])
                        segment, pivot, least, most = ring[dim]
                        d = to_pivots(q, pivots[dim], m2[dim], query=True)[:, pivot]
                        gap = np.maximum(np.maximum(least - d, d - most), 0)
                        reach = ((q.astype(float) ** 2).sum(1)[:, None] + m2[dim] - np.maximum(gap - SLACK * np.sqrt(m2[dim]) - SLACK, 0) ** 2) / 2
                        if first:
                            # The ring that holds the query's own key, or the nearest to it.
                            own = to_pivots(q, pivots[dim], m2[dim])[:, pivot]
                            away = np.maximum(np.maximum(least - own, own - most), 0) + 1e-3 * own
                            wanted = np.zeros(d.shape, bool)
                            wanted[np.arange(len(ids)), away.argmin(1)] = True
                        else:
                            wanted = reach >= floors[:, None] - 1
                        for j in np.flatnonzero(wanted.any(0))[np.argsort(-reach[:, wanted.any(0)].max(0))]:
                            on = wanted[:, j]
                            cells = [int(segment[j]), ids[on].tobytes(), q[on].tobytes(), floors[on].tobytes()]
                            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

        return emit

    queries = rows.filter("asks").dropDuplicates(["vec_id"]).select("vec_id", "v", "dim")
    asked = "segment long, queries binary, qvectors binary, floors binary"
    near = search(index, queries.mapInArrow(plan(True), asked), m2, k, "near")
    floors = ranked(near, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    found = search(index, queries.join(floors, "vec_id", "left").mapInArrow(plan(False), asked), m2, k, "found")
    return ranked(found, k)


def op5_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.table(spark, sf_dir, "embeddings")
    return top_k(table.select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
