"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

A set is hashed by one permutation; a second one, applied after a circular shift by k, gives coordinate k of the
signature: min over x of p((s(x) + k * STRIDE) mod 2**32).  BANDS bands of ROWS coordinates give the candidates:
at a Jaccard similarity of 0.75 a pair is missed by all bands with probability (1 - 0.75**ROWS)**BANDS = 5e-6, less above.
Links are confirmed on the full sets.

Equal sets are one class from the start, so copies cost one row.  Of a bucket's pairs only those are compared that can
still join two components:
  1. every class with the smallest class that it shares any bucket with,
  2. every class with the smallest class of each of its buckets, where their components differ,
  3. the pairs of a bucket whose components still differ.
The third step leaves no candidate pair undecided.  Buckets of at most SMALL_BUCKET classes give their pairs as rows.  The
classes of larger ones meet by an exact prefix filter instead: with shingles in one order, two sets at 0.75 share one of their
n - ceil(0.75 n) + 1 first shingles, so only classes with a common shingle there are compared, and only those of different
components.  The order goes from rare to frequent by a sketch of SLOTS counts, all that the driver gets; any order is exact.  Shingles that over SMALL_BUCKET prefixes still share form groups; their classes are dealt into blocks of about BLOCK, a
component of that size into blocks of its own, and every two blocks that hold different components meet in one task of
bounded size, which compares their full sets and returns a spanning forest of the links.

Links and components stay distributed; components are found by alternating large-star and small-star steps.

Defined results: words are cut at ASCII white space after lower-casing A-Z; a text of fewer than SHINGLE words has one
shingle, its whole sequence; null, empty and blank texts have an empty set and are linked with nothing; rows with
a null doc_id likewise; every different text is a node, so a doc_id that comes with several texts has the links of
each on the row that holds it, and equal rows are one node; an empty table gives no rows; other columns are ignored.  Shingles are compared by 55-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
PERCENT = 75
ROWS = 5
BANDS = 45
STRIDE = 0x9E3779B1
SMALL_BUCKET = 64
BLOCK = 192
#: Slots of the sketch of shingle frequencies.
SLOTS = 1 << 18
#: Columns of the 0/1 matrices by which a task counts intersections.
COLUMNS = 16_384

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BITS = np.uint64(55)
_MASK = np.uint64((1 << 55) - 1)


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the sorted sets of distinct shingles of a column of at most 512 texts."""
    off, raw = common.utf8(text)
    h, _, _, first = common.words(off, _LOWER[raw])
    n = np.diff(first)
    sizes = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), sizes)
    start = np.repeat(first[:-1], sizes) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    short = n[row] < SHINGLE
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    g = np.zeros(len(row), np.uint64)
    for j in range(SHINGLE):
        inside = j < n[row]
        g = g * common._B + np.where(inside | ~short, padded[start + j], np.uint64(j + 7))
    key = np.unique((row.astype(np.uint64) << _BITS) | (common.mix(g) & _MASK))
    offsets = np.append(np.searchsorted(key, np.arange(len(n)).astype(np.uint64) << _BITS), len(key))
    return offsets, key & _MASK


def signatures(offsets: np.ndarray, values: np.ndarray, coordinates: int) -> np.ndarray:
    """Shape (coordinates, sets without the empty ones)."""
    x = (common.mix(values + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((coordinates, len(starts)), np.uint32)
    y, t = np.empty_like(x), np.empty_like(x)
    for k in range(coordinates):
        np.add(x, np.uint32((k * STRIDE) & 0xFFFFFFFF), out=y)
        # A bijection of 32-bit integers: odd multipliers and shifted sums.
        np.right_shift(y, 16, out=t)
        np.bitwise_xor(y, t, out=y)
        np.multiply(y, np.uint32(0x85EBCA6B), out=y)
        np.right_shift(y, 13, out=t)
        np.bitwise_xor(y, t, out=y)
        np.multiply(y, np.uint32(0xC2B2AE35), out=y)
        out[k] = np.minimum.reduceat(y, starts)
    return out


def _set_keys(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for empty ones."""
    full = np.diff(offsets) > 0
    k1, k2 = np.zeros(len(full), np.uint64), np.zeros(len(full), np.uint64)
    if full.any():
        starts = offsets[:-1][full]
        k1[full] = np.add.reduceat(common.mix(values ^ np.uint64(0x5BD1E995)), starts)
        k2[full] = np.add.reduceat(common.mix(values * np.uint64(3) + np.uint64(11)), starts)
    return k1, k2


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offsets, values = shingle_sets(b.column("text"))
        n = np.diff(offsets)
        full = n > 0
        k1, k2 = _set_keys(offsets, values)
        bands = np.zeros((len(n), BANDS), np.uint64)
        if full.any():
            sig = signatures(offsets, values, ROWS * BANDS).astype(np.uint64)
            for j in range(BANDS):
                g = np.full(full.sum(), j + 1, np.uint64)
                for i in range(ROWS):
                    g = common.mix(g * common._B + sig[j * ROWS + i])
                bands[full, j] = g
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), keys], ["doc_id", "row_key", "n_shingles", "k1", "k2", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offsets, values = shingle_sets(b.column("text"))
        k1, k2 = _set_keys(offsets, values)
        members = pa.array([values[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), members], ["doc_id", "k1", "k2", "members"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the batch fall into each slot of the frequency sketch."""
    for b in batches:
        values = np.frombuffer(b"".join(b.column("members").to_pylist()), np.uint64)
        slot, count = np.unique(values % np.uint64(SLOTS), return_counts=True)
        yield from common.as_batches({"slot": slot.astype(np.int64), "c": count}, pa.schema([("slot", pa.int64()), ("c", pa.int64())]))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("x"), b.column("y")):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) of the nodes whose component has a smaller id, from edges (a, b): label is that smallest id."""
    e = common.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def stars(edges: DataFrame) -> bool:
        """Whether every node has one edge down or is a root."""
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down + up > 1").isEmpty()

    for _ in range(rounds):
        if stars(e):
            break
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        e = common.stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = common.stored(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small")
    else:
        raise RuntimeError(f"components are not done after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    xy = x.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return common.stored(xy.mapInArrow(_linked, "a long, b long"), "links")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices a slice of values at a time."""
    n = len(sets)
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    # A value of one set meets nothing.
    place = np.cumsum(count > 1) - 1
    shared = count[at] > 1
    at, owner = place[at[shared]], owner[shared]
    out = np.zeros((n, n), np.float64)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        i, j = np.searchsorted(at, (first, first + COLUMNS))
        x = np.zeros((n, int(at[j - 1]) - first + 1), np.float32)
        x[owner[i:j], at[i:j] - first] = 1
        out += x @ x.T
    return out


def _block_links(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets."""
    size = np.array([len(s) for s in sets], float)
    both = intersections(sets)
    linked = np.triu(100 * both >= PERCENT * (size[:, None] + size[None, :] - both), 1)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((ids[i], ids[j]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, id, members) sorted by pair of blocks; each pair is compared as a whole."""

    def compare(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            got = _block_links(ids, sets)
            yield from common.as_batches({"a": [x for x, _ in got], "b": [y for _, y in got]}, _LINKS)

    now, ids, sets = None, [], []
    for b in batches:
        for pair, i, members in zip(b.column("pair").to_pylist(), b.column("id").to_pylist(), b.column("members")):
            if pair != now:
                yield from compare(ids, sets)
                now, ids, sets = pair, [], []
            ids.append(i)
            sets.append(np.frombuffer(members.as_buffer(), np.uint64).copy())
    yield from compare(ids, sets)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(token, id, n, l, c) of prefix shingles that classes of different components share; c classes have the shingle in their prefix."""
    rows = common.stored(members.join(sets, "id"), "rows")
    counts = np.zeros(SLOTS, np.int64)
    for slot, c in rows.select("members").mapInArrow(_slots, "slot long, c long").groupBy("slot").agg(F.sum("c")).collect():
        counts[slot] = c
    shared = members.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("l", pa.int64())])
        often = shared.value
        for b in batches:
            out: list[tuple] = []
            for i, n, label, raw in zip(*(b.column(c).to_pylist() for c in ("id", "n", "l", "members"))):
                x = np.frombuffer(raw, np.uint64)
                count = often[x % np.uint64(SLOTS)]
                near = np.lexsort((x, count))[: n - (PERCENT * n + 99) // 100 + 1]
                # A shingle that is alone in its slot is in no other set.
                out += [(t, i, n, label) for t in x[near[count[near] > 1]].astype(np.int64).tolist()]
            yield from common.as_batches(dict(zip(schema.names, map(list, zip(*out)))) if out else dict.fromkeys(schema.names, []), schema)

    tokens = common.stored(rows.mapInArrow(first, "token long, id long, n long, l long"), "prefixes")
    mixed = tokens.groupBy("token").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.count("*").alias("c")).filter("lo <> hi").select("token", "c")
    return common.stored(tokens.join(mixed, "token"), "meeting")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """(id, pair) of the classes of rows (token, id, l), once for each pair of blocks in which it is compared."""
    heads = common.stored(rows.groupBy("token").agg(F.min("id").alias("head")), "heads")
    group = components(rows.join(heads, "token").select(F.col("id").alias("a"), F.col("head").alias("b")))
    member = common.stored(rows.select("id", "l").distinct().join(group, "id", "left").select("id", "l", F.coalesce("label", "id").alias("g")), "members")
    each = member.groupBy("g", "l").agg(F.count("*").alias("c"))
    whole = F.col("c") >= BLOCK
    size = each.groupBy("g", F.when(whole, F.col("l")).alias("own")).agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("k"))
    size = common.stored(size, "sizes")
    own = member.join(each.filter(whole).select("g", "l", F.col("l").alias("own")), ["g", "l"], "left")
    own = own.join(size.withColumnsRenamed({"g": "g2", "own": "own2"}), (F.col("g") == F.col("g2")) & F.col("own").eqNullSafe(F.col("own2")))
    # Classes of one small component stay in one block.
    block = F.pmod(F.when(F.col("own").isNull(), F.xxhash64("l")).otherwise(F.xxhash64("id")), F.col("k").cast("long")).cast("int")
    own = common.stored(own.select("id", "g", F.coalesce("own", F.lit(-1)).alias("own"), block.alias("b")), "blocks")
    blocks = own.select("g", "own", "b").distinct()
    left, right = (blocks.select("g", F.struct("own", "b").alias(k)) for k in ("i", "j"))
    pairs = left.join(right, "g").filter((F.col("i") <= F.col("j")) & ((F.col("i")["own"] != F.col("j")["own"]) | (F.col("i")["own"] < 0)))
    pairs = common.stored(pairs.select("g", "i", "j", F.concat_ws(":", "g", "i.own", "i.b", "j.own", "j.b").alias("pair")), "block_pairs")
    at = own.select("id", "g", F.struct("own", "b").alias("x"))
    ends = pairs.select("g", F.col("i").alias("x"), "pair").unionByName(pairs.filter("i <> j").select("g", F.col("j").alias("x"), "pair"))
    return at.join(ends, ["g", "x"]).select("id", "pair")


def _grouped_links(members: DataFrame, sets: DataFrame, done: DataFrame, parts: int) -> DataFrame:
    """Links between components of classes (id, n, l) of large buckets, beyond the pairs that are done."""
    meeting = _prefixes(members, sets)
    links = _confirmed(common.stored(_pairs_of(meeting.filter(F.col("c") <= SMALL_BUCKET), "token").join(done, ["a", "b"], "left_anti"), "pairs"), sets)
    large = meeting.filter(F.col("c") > SMALL_BUCKET).select("token", "id", "l")
    if large.isEmpty():
        return links
    dealt = _block_pairs(large).join(sets, "id").select("pair", "id", "members")
    return links.unionByName(common.stored(dealt.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(_blocks, "a long, b long"), "links"))


def _pairs_of(rows: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of classes of different components and fitting sizes that share a key, from rows (key, id, n, l) with bounded keys."""
    x, y = rows.select(key, F.col("id").alias("a"), F.col("n").alias("na"), F.col("l").alias("la")), rows.select(key, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("l").alias("lb"))
    near = x.join(y, key).filter((F.col("la") != F.col("lb")) & (F.col("a") < F.col("b")) & _fits(F.col("na"), F.col("nb")))
    return near.select("a", "b").distinct()


def _fits(n: Column, m: Column) -> Column:
    """Sizes that a linked pair can have."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and row_key, the hash of (doc_id, text), of every row of ``docs`` (doc_id, text)."""
    common.prepare(docs.sparkSession)
    docs, parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), common.partitions(docs)
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    sketch = common.stored(keyed.mapInArrow(_sketch, "doc_id long, row_key long, n_shingles long, k1 long, k2 long, bands array<long>"), "sketch")
    able = sketch.filter("n_shingles > 0 and doc_id is not null")
    # A class is a text's set; its number is fixed once the table is written.
    classes = able.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = common.stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    node = classes.select(F.col("rep").alias("doc_id"), "k1", "k2", "id")
    at = ["doc_id", "k1", "k2"]
    reps = common.stored(able.join(node, at).dropDuplicates(at).select("id", F.col("n_shingles").alias("n"), "bands"), "reps")

    # Buckets with more than one class.
    spread = reps.select("id", "n", F.explode("bands").alias("bucket"))
    centres = common.stored(spread.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("far")).filter("centre <> far").drop("far"), "centres")
    shared = common.stored(spread.join(centres, "bucket"), "shared")
    wanted = common.stored(node.join(shared.select("id").distinct(), "id"), "wanted")
    # Both sides grow with the table, so they meet in the same way at every size.
    sets = docs.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id long, k1 long, k2 long, members binary")
    sets = common.stored(sets.join(wanted, at).dropDuplicates(at).select("id", "members"), "sets")

    done = common.stored(shared.filter("id <> centre").groupBy("id").agg(F.min("centre").alias("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b")), "pairs")
    links = _confirmed(done, sets)
    labels = components(links)

    def labelled(rows: DataFrame, key: str, name: str) -> DataFrame:
        got = labels.select(F.col("id").alias(key), F.col("label").alias("_l"))
        return rows.join(got, key, "left").withColumn(name, F.coalesce("_l", key)).drop("_l")

    for last in (False, True):
        grouped = None
        if last:
            mine = common.stored(labelled(shared.select("bucket", "id", "n"), "id", "l"), "labelled")
            mixed = common.stored(mine.groupBy("bucket").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.count("*").alias("c")).filter("lo <> hi").select("bucket", "c"), "mixed")
            left = common.stored(mine.join(mixed, "bucket"), "left")
            large = left.filter(F.col("c") > SMALL_BUCKET).select("id", "n", "l").distinct()
            if not large.isEmpty():
                grouped = _grouped_links(common.stored(large, "large"), sets, done, parts)
            more = _pairs_of(left.filter(F.col("c") <= SMALL_BUCKET), "bucket")
        else:
            stars = shared.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
            more = labelled(labelled(stars, "a", "la"), "b", "lb").filter("la <> lb")
        more = common.stored(more.select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        some = not more.isEmpty()
        if some:
            done = done.unionByName(more)
            links = links.unionByName(_confirmed(more, sets))
        if grouped is not None:
            links = links.unionByName(grouped)
        if some or grouped is not None:
            labels = components(links)

    # Components of classes, then of rows: both sides are stored, so a hot class can be split over tasks.
    named = common.stored(labelled(classes, "id", "l").select("k1", "k2", "rep", "l"), "labelled")
    least = common.stored(named.groupBy("l").agg(F.min("rep").alias("component_id")), "least")
    named = common.stored(named.join(least, "l").select("k1", "k2", "component_id"), "named")
    out = sketch.select("doc_id", "row_key", "n_shingles", "k1", "k2").withColumn("able", F.expr("n_shingles > 0 and doc_id is not null"))
    out = out.join(named.withColumn("able", F.lit(True)), ["k1", "k2", "able"], "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "row_key")


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row_key")
