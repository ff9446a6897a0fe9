"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

A fingerprint has a bit for each bit of a 64-bit hash, set where more than half of the text's shingle hashes have it set.  A covering
family for radius r gives each bit position a nonzero code of r + 1 bits; table v, for each of the 2^(r+1) - 1 nonzero v, keeps the
positions whose code has an odd product with v.  At most r positions differ in a pair within the radius, so their codes lie in
at most r of r + 1 dimensions and some v is orthogonal to all of them: in that table the two agree.  Every table keeps about
half of the positions.

Distinct fingerprints, not documents, meet in the tables.  A bucket with more than ``GROUP`` of them is not compared as it is: its members
agree on the table's positions and can differ only in the rest, so they are dealt again by a covering family of the remaining
positions, as often as needed; below ``FEW`` remaining positions a bucket holds at most 2^FEW fingerprints.  Candidates are confirmed by
their distance, and links become components (``neardup.components``).

Defined results: a text without words has fingerprint zero, which is linked like any other; fewer words than a shingle are one
shingle; rows with a null doc_id are linked too, and component_id is the smallest id that is not null (null where there is none);
texts of one doc_id that are not linked keep their own components; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, neardup

WORDS = 3
SEED = 42
RADIUS = 3
BITS = 64
#: Fingerprints of a bucket that are compared as they are.
GROUP = 64
#: Remaining positions below which buckets are compared whatever their size.
FEW = 8
#: Shingles whose bits are counted at once.
STEP = 1 << 15

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a text as an unsigned number."""
    parts = text.translate(_LOWER).split() if text else []
    if not parts:
        return 0
    runs = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else iter([b" ".join(parts)])
    total, n = np.zeros(BITS, np.int64), max(1, len(parts) - words + 1)
    while chunk := list(map(xxhash.xxh64_intdigest, itertools.islice(runs, STEP), itertools.repeat(seed))):
        total += np.unpackbits(np.array(chunk, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def covering(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the positions: two numbers that differ in at most ``radius`` of them agree under at least one mask."""
    codes = (1 << radius + 1) - 1
    return [sum(1 << p for k, p in enumerate(positions) if ((k % codes + 1) & v).bit_count() % 2) for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables_of(parents: list[tuple[int, int]], radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(parent, table, mask) of the covering tables of the positions that each parent (table, mask) does not keep."""
    out = []
    for name, mask in parents:
        rest = [p for p in range(BITS) if not mask >> p & 1]
        if len(rest) > FEW:
            out += [(name, name * 1000 + k, mask | m) for k, m in enumerate(covering(rest, radius), 1)]
    return out


def near(a: Column, b: Column, radius: int = RADIUS) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def links(prints: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(a, b) ids of the distinct fingerprints (id, fp) within the radius; every such pair at least once."""
    spark = prints.sparkSession
    rows, parents, out = prints.select(F.lit(0).cast("long").alias("t"), "id", "fp"), [(0, 0)], None
    while family := tables_of(parents, radius):
        # At most 15, 225 or 3,375 rows: masks alone, whatever the data.
        masks = spark.createDataFrame([(p, t, _signed(m), BITS - m.bit_count() <= FEW) for p, t, m in family], "t long, child long, mask long, last boolean")
        dealt = rows.join(F.broadcast(masks), "t").select(F.col("child").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "id", "fp", "last")
        dealt = common.stored(dealt, "dealt")
        size = common.stored(dealt.groupBy("t", "key").agg(F.count("*").alias("n"), F.first("last").alias("last")).filter("n > 1"), "sizes")
        small = (F.col("n") <= group) | F.col("last")
        held = dealt.drop("last").join(size.filter(small).select("t", "key"), ["t", "key"])
        x, y = held.select("t", "key", F.col("id").alias("a"), F.col("fp").alias("x")), held.select("t", "key", F.col("id").alias("b"), F.col("fp").alias("y"))
        found = x.join(y, ["t", "key"]).filter((F.col("a") < F.col("b")) & near(F.col("x"), F.col("y"), radius)).select("a", "b")
        found = common.stored(found.distinct(), "links")
        out = found if out is None else out.unionByName(found)
        large = size.filter(~small).select("t", "key")
        if large.isEmpty():
            break
        # Members of one bucket stay apart from other buckets' by the positions that the key holds.
        rows = common.stored(dealt.join(large, ["t", "key"]).select("t", "id", "fp"), "large")
        parents = [(t, m) for _, t, m in family]
    return out


def simhash_components(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """doc_id, fp (signed long), component_id and kept of every row of ``docs`` (doc_id, text)."""
    common.prepare(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t, words, seed) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    rows = common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, fp long"), "prints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    prints = common.stored(prints.withColumn("id", F.monotonically_increasing_id()), "classes")
    labels = neardup.components(links(prints, radius, group))
    named = prints.join(labels, "id", "left").select("fp", "rep", F.coalesce("label", "id").alias("l"))
    least = common.stored(named.groupBy("l").agg(F.min("rep").alias("component_id")), "least")
    named = common.stored(named.join(least, "l").select("fp", "component_id"), "named")
    # Both sides are stored, so a fingerprint that many rows have can be split over tasks.
    out = rows.join(named, "fp", "left")
    return out.select("doc_id", "fp", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op13_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
