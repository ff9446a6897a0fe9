"""Hilbert-curve ordering: quantise several metadata dimensions, sort by curve index, cut runs.

``hilbert_shards`` gives every row a curve position and cuts the total order into runs whose
counts differ by at most one (law ``rows``).  Rows that are near on the curve agree in most
dimensions, so files of one run have narrow ranges in all of them at once, and
``prune`` drops files by several dimensions.

Defined results: a null or empty text has size 1 and checksum 0; a null dimension goes to cell 0;
equal curve positions are ordered by text checksum and doc_id, so copies of a text lie side by
side; a group of copies or one hot source is cut wherever the count says so, never kept in one
shard.  Repeated rows keep one slot each.  An empty table gives no rows.  Further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 8
N_SHARDS = 16


def with_curve(df: DataFrame, name: str, *cells: Column, bits: int = BITS) -> DataFrame:
    """``df`` with the Hilbert index of cells from 0 to 2**bits - 1 (Skilling's transpose form), by shifts and xors of columns.

    Every step is a projection of its own, so that each reads the columns of the one before.
    """
    x = [common.free_name(df, f"cell{i}") for i in range(len(cells))]
    set_in = lambda c, q: F.col(c).bitwiseAND(F.lit(q).cast("long")) != 0
    out = df.withColumns({k: c.cast("long") for k, c in zip(x, cells)})
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, F.lit((1 << b) - 1).cast("long")
        out = out.withColumn(x[0], F.when(set_in(x[0], q), F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0])))
        for k in x[1:]:
            # Bit set: invert the lower bits of the first cell; clear: swap them with this one's.
            swap = F.col(x[0]).bitwiseXOR(F.col(k)).bitwiseAND(low)
            out = out.withColumns({
                x[0]: F.when(set_in(k, q), F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0]).bitwiseXOR(swap)),
                k: F.when(set_in(k, q), F.col(k)).otherwise(F.col(k).bitwiseXOR(swap)),
            })
    xor = lambda cs: functools.reduce(lambda p, c: p.bitwiseXOR(c), cs)
    out = out.withColumns({k: xor([F.col(c) for c in x[: i + 1]]) for i, k in enumerate(x)})
    flip = xor([F.when(set_in(x[-1], 1 << b), F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long") for b in range(bits - 1, 0, -1)])
    turn = common.free_name(df, "turn")
    out = out.withColumn(turn, flip)
    bit = lambda k, b: F.shiftright(F.col(k).bitwiseXOR(F.col(turn)), b).bitwiseAND(F.lit(1).cast("long"))
    index = sum((F.shiftleft(bit(k, b), b * len(x) + len(x) - 1 - i) for b in range(bits) for i, k in enumerate(x)), F.lit(0).cast("long"))
    return out.withColumn(name, index).drop(*x, turn)


def category_cell(c: Column) -> Column:
    """Cell of a categorical dimension: a byte of a stable hash; null goes to cell 0."""
    return F.when(c.isNull(), 0).otherwise(F.conv(F.left(F.md5(c.cast("string").cast("binary")), F.lit(2)), 16, 10).cast("int"))


def size_cell(c: Column) -> Column:
    """Cell of a count: eight steps per doubling; null and 0 go to cell 0."""
    return F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) + 1) * 8)).cast("int")


def ranked(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``df`` with ``rank`` from 0 in the total order of ``order``: one range shuffle, no single-task sort.

    The sorted rows are stored, since range bounds are sampled anew in every run; the only thing that
    meets in one place is a row count for each partition.
    """
    spark = df.sparkSession
    n = common.partitions(df)
    pos = F.monotonically_increasing_id()
    part = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumns({"part": F.shiftrightunsigned(pos, 33).cast("int"), "pos": pos.bitwiseAND(F.lit((1 << 33) - 1))})
    )
    part = common.stored(part, tag)
    base, total = {}, 0
    for r in sorted(part.groupBy("part").count().collect()):
        base[r["part"]] = total
        total += r["count"]
    steps = spark.createDataFrame([(k, v) for k, v in base.items()], "part int, base long")
    return part.join(F.broadcast(steps), "part").withColumns({"rank": F.col("base") + F.col("pos"), "total": F.lit(total).cast("long")}).drop("part", "pos", "base")


def hilbert_shards(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, curve, law, shard, slot, grown_shard, lang, source."""
    keyed = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.col("lang"),
        F.col("source"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("length"),
    )
    keyed = with_curve(keyed, "curve", category_cell(F.col("source")), category_cell(F.col("lang")), size_cell(F.col("length")))
    rows = ranked(keyed, ["curve", "text_crc32", "doc_id"], "curve")
    # First rank of shard s is ceil(s * total / n), so counts are floor or ceil of total / n.
    shard = F.expr(f"cast((rank * {n_shards}L) div total as int)")
    first = F.expr(f"((shard * total) + {n_shards - 1}L) div {n_shards}L")
    return rows.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard",
        (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "lang", "source", "length",
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> DataFrame:
    """Write ``docs`` below ``path``, a folder per shard in slot order, and return the manifest of ranges by shard."""
    plan = hilbert_shards(docs, n_shards).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot", "curve")
    plan = plan.dropDuplicates(["_id", "_crc"])
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    out = docs.join(plan, docs["doc_id"].eqNullSafe(plan["_id"]) & (crc == plan["_crc"])).drop("_id", "_crc")
    out.repartitionByRange(n_shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    m = docs.sparkSession.read.parquet(path)
    ranges = [f(c).alias(f"{n}_{c}") for c in ("lang", "source", "n_chars") if c in docs.columns for n, f in (("min", F.min), ("max", F.max))]
    return m.groupBy("shard").agg(F.count("*").alias("rows"), F.collect_set("source").alias("sources"), F.collect_set("lang").alias("langs"), *ranges)


def prune(manifest: DataFrame, source: str | None = None, lang: str | None = None, n_chars: tuple[int, int] | None = None) -> DataFrame:
    """Shards that can hold rows with the given source, language and length range."""
    m = manifest
    if source is not None:
        m = m.filter(F.array_contains("sources", source))
    if lang is not None:
        m = m.filter(F.array_contains("langs", lang))
    if n_chars is not None:
        m = m.filter((F.col("max_n_chars") >= n_chars[0]) & (F.col("min_n_chars") <= n_chars[1]))
    return m.select("shard")


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    out = hilbert_shards(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")
