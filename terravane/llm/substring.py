"""Substring dedup: words covered by a window that also starts in a document with a smaller doc_id.

A window is ``WINDOW`` consecutive words.  Every window has an anchor, its smallest ``GRAM``-word hash; equal windows have
equal anchors, so a shard, the anchors of one hash range, can hold all occurrences of a window.

  1. Candidates: runs of windows with one anchor, where two documents have the anchor.  Anchors in over ``HOT_ROWS`` places
     (a phrase that many documents have) keep of their windows only those whose 32-bit hash comes back in another document, counted
     window by window with map-side sums.  Neither drops a window that repeats.
  2. The words of a run are a sequence.  Equal sequences are one entry with its smallest doc_id.
  3. A shard, the sequences of some anchors, decides by compressed FM-indexes (``fmindex``).  The documents of an anchor are halved by
     doc_id: the sequences of the lower half are indexed, those of the upper half are streamed through the index, and both halves
     go on alike, so every sequence meets every smaller document and never itself.  Backward search over the wavelet matrix gives
     matching statistics; intervals that reach ``WINDOW`` words are repeats of a smaller document.  One index serves all anchors of a
     shard at a level of halving.  Words are compared as words here, not as hashes.  An anchor with over ``GROUP`` sequences is
     dealt into blocks, and every two blocks meet in a task of their own.
  4. A document's windows that a smaller document has cover its words, judged on the input.

Words are runs of anything but ASCII white space.  Defined results: null, empty and short texts lose nothing; a row
with a null doc_id neither loses words nor takes them; rows with one doc_id do not take words from each other; a table
without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fmindex import FMIndex

WINDOW = 50
GRAM = 10
HOT_ROWS = 200
#: Sequences of one anchor that one task takes.
GROUP = 1_000
#: Words in a shard's indexes; a group is never split.
INDEX_WORDS = 400_000
#: Windows in a sequence.
LONGEST = 64


def anchors(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, first window, windows, all window hashes) by runs of windows with one anchor."""
    off, raw = common.utf8(text)
    h, _, _, first = common.words(off, raw)
    n = np.diff(first)
    m = np.maximum(n - WINDOW + 1, 0)
    none = np.zeros(0, np.int64)
    if not m.sum():
        return none, none, none, none, np.zeros(0, np.uint32)
    g = common.grams(h, GRAM)
    width = WINDOW - GRAM + 1
    at = np.lib.stride_tricks.sliding_window_view(g, width).argmin(1) + np.arange(len(g) - width + 1)
    power, inverse = common._powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    row = np.repeat(np.arange(len(n)), m)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    start = first[row] + pos
    whole = (common.mix((total[start + WINDOW] - total[start]) * inverse[start]) >> np.uint64(32)).astype(np.uint32)
    anchor = at[start]
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    cut = np.flatnonzero(new)
    return row[cut], g[anchor[cut]].view(np.int64), pos[cut], np.diff(np.append(cut, len(row))), whole


def _anchor_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, h, *_ = anchors(b.column("text"))
        yield from common.as_batches({"h": np.asarray(h, np.int64), "doc_id": np.asarray(b.column("doc_id"))[row]}, pa.schema([("h", pa.int64()), ("doc_id", pa.int64())]))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
    for b in batches:
        row, h, start, count, _ = anchors(b.column("text"))
        if len(row):
            yield from common.as_batches({"h": h, "row_key": np.asarray(b.column("row_key"))[row], "start": start, "n": count}, schema)


_WINDOWS = pa.schema([("h", pa.int64()), ("w", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("starts", pa.list_(pa.int32()))])


def _anchor_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different anchor of a document, with the places and hashes of all its windows."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("places", pa.binary()), ("hashes", pa.binary())])
    for b in batches:
        row, h, start, count, whole = anchors(b.column("text"))
        if not len(row):
            continue
        run = np.repeat(np.arange(len(row)), count)
        place = (start[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        by = np.lexsort((place, h[run], row[run]))
        run, place, whole = run[by], place[by], whole[by]
        new = np.ones(len(run), bool)
        new[1:] = (row[run[1:]] != row[run[:-1]]) | (h[run[1:]] != h[run[:-1]])
        cut = np.flatnonzero(new)
        edge = (np.append(cut, len(run)) * 4).astype(np.int32)
        cells = [pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(x.tobytes())]) for x in (place, whole)]
        at = row[run[cut]]
        yield from common.as_batches({"h": h[run[cut]], "doc_id": np.asarray(b.column("doc_id"))[at], "row_key": np.asarray(b.column("row_key"))[at], "places": cells[0], "hashes": cells[1]}, schema, 10_000)


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different window hash that a document has with a hot anchor, with all its places."""
    for b in batches:
        if not b.num_rows:
            continue
        h, doc, key = (np.asarray(b.column(c)) for c in ("h", "doc_id", "row_key"))
        hashes = b.column("hashes").to_pylist()
        whole, place = np.frombuffer(b"".join(hashes), np.int32), np.frombuffer(b"".join(b.column("places").to_pylist()), np.int32)
        row = np.repeat(np.arange(len(h)), [len(x) // 4 for x in hashes])
        by = np.lexsort((place, whole, h[row], key[row]))
        row, whole, place = row[by], whole[by], place[by]
        new = np.ones(len(row), bool)
        new[1:] = (key[row[1:]] != key[row[:-1]]) | (h[row[1:]] != h[row[:-1]]) | (whole[1:] != whole[:-1])
        cut = np.flatnonzero(new)
        starts = pa.ListArray.from_arrays(pa.array(np.append(cut, len(row)), pa.int32()), pa.array(place, pa.int32()))
        yield from common.as_batches({"h": h[row[cut]], "w": whole[cut], "doc_id": doc[row[cut]], "row_key": key[row[cut]], "starts": starts}, _WINDOWS)


def candidate_runs(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(row_key, h, starts, n) of runs of windows that can repeat, from (doc_id, row_key, text)."""
    keys = docs.mapInArrow(_anchor_keys, "h long, doc_id long").groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c"))
    met = common.stored(keys.filter("lo < hi").select("h", (F.col("c") > hot_rows).alias("hot")), "met")
    hot = met.filter("hot").select("h")
    rows = docs.mapInArrow(_anchor_rows, "h long, row_key long, start int, n int")
    calm = rows.join(met.filter("not hot").select("h"), "h", "left_semi").select("row_key", "h", F.array("start").alias("starts"), "n")
    if hot.isEmpty():
        return calm
    groups = docs.mapInArrow(_anchor_groups, "h long, doc_id long, row_key long, places binary, hashes binary")
    each = groups.join(hot, "h", "left_semi").mapInArrow(_hot_windows, "h long, w int, doc_id long, row_key long, starts array<int>")
    each = common.stored(each, "windows")
    shared = common.stored(each.groupBy("h", "w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h", "w"), "shared")
    return calm.unionByName(each.join(shared, ["h", "w"]).select("row_key", "h", "starts", F.lit(1).alias("n")))


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with candidates keep their text; of the others the result is final."""
    for b in batches:
        sha, size = [], []
        for text, runs in zip(b.column("text").to_pylist(), b.column("runs").is_valid().to_pylist()):
            w = (text or "").encode().split()
            size.append(len(w))
            sha.append(None if runs else hashlib.sha256(b" ".join(w)).hexdigest())
        names = ["doc_id", "row_key", "runs"]
        text = pa.array([t if s is None else None for t, s in zip(b.column("text").to_pylist(), sha)], pa.string())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), text, pa.array(size, pa.int64()), pa.array(sha, pa.string())], [*names, "text", "n_words", "kept_sha256"])


_SEQS = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("seq_key", pa.binary()), ("seq", pa.string())])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for key, doc, text, runs in zip(*(b.column(c).to_pylist() for c in ("row_key", "doc_id", "text", "runs"))):
            w = text.encode().split()
            # Windows of one anchor side by side, however they were found, make one sequence.
            joined: list[list[int]] = []
            for h, start, n in sorted((r["h"], start, r["n"]) for r in runs for start in r["starts"]):
                if joined and joined[-1][0] == h and joined[-1][1] + joined[-1][2] >= start and start + n - joined[-1][1] <= LONGEST:
                    joined[-1][2] = max(joined[-1][2], start + n - joined[-1][1])
                else:
                    joined.append([h, start, n])
            for h, start, n in joined:
                seq = b" ".join(w[start : start + n + WINDOW - 1])
                out.append((key, doc, h, start, n, xxhash.xxh3_128_digest(seq + h.to_bytes(8, "little", signed=True)), seq.decode()))
        cols = list(zip(*out)) or [()] * 7
        yield from common.as_batches({f.name: list(c) for f, c in zip(_SEQS, cols)}, _SEQS, 2_000)


_FOUND = pa.schema([("seq_key", pa.binary()), ("lo", pa.int64()), ("mask", pa.binary())])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first .. first + size - 1 of each, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def match_sequences(groups: list[int], seqs: list[str], docs: list[int]) -> list[np.ndarray]:
    """For each sequence, which of its windows a sequence of its group with a smaller document has."""
    ids: dict[bytes, int] = {}
    cells, sizes = [], []
    for s in seqs:
        w = s.encode().split()
        cells += [ids.setdefault(x, len(ids)) for x in w]
        sizes.append(len(w))
    words, size, owner = np.array(cells, np.int64), np.array(sizes, np.int64), np.array(docs, np.int64)
    first = np.cumsum(size) - size
    found = np.zeros(len(words), bool)
    node = np.unique(np.array(groups, np.int64), return_inverse=True)[1]
    here = np.arange(len(size))
    while True:
        # Ranks of the documents within their node; nodes of one document are done.
        by = np.lexsort((owner[here], node))
        here, node = here[by], node[by]
        opens = np.ones(len(here), bool)
        opens[1:] = node[1:] != node[:-1]
        step = opens.copy()
        step[1:] |= owner[here[1:]] != owner[here[:-1]]
        rank = np.cumsum(step) - 1
        rank -= rank[np.maximum.accumulate(np.where(opens, np.arange(len(here)), 0))]
        docs_in = np.maximum.reduceat(rank, np.flatnonzero(opens))[np.cumsum(opens) - 1] + 1 if len(here) else rank
        keep = docs_in > 1
        here, node, upper = here[keep], node[keep], (rank >= (docs_in + 1) // 2)[keep]
        if not len(here):
            break
        _stream(words, first, size, here[~upper], node[~upper], here[upper], node[upper], len(ids), found)
        node = node * 2 + upper
        node = np.unique(node, return_inverse=True)[1]
    return [found[a : a + n - WINDOW + 1] for a, n in zip(first.tolist(), size.tolist())]


def _stream(words: np.ndarray, first: np.ndarray, size: np.ndarray, low: np.ndarray, low_node: np.ndarray, high: np.ndarray, high_node: np.ndarray, symbols: int, found: np.ndarray) -> None:
    """Index the sequences ``low``, stream ``high`` and mark places in ``found`` where a window of a sequence of the same node starts."""
    at, to = _ranges(first[low], size[low]), _ranges(first[high], size[high])
    # A word is one symbol for each node, so that nodes do not meet.
    have, text = np.unique(words[at] + np.repeat(low_node, size[low]) * symbols, return_inverse=True)
    want = words[to] + np.repeat(high_node, size[high]) * symbols
    near = np.minimum(np.searchsorted(have, want), len(have) - 1)
    query = np.where(have[near] == want, near + 1, -1)
    ends = np.cumsum(size[low] + 1) - 1
    padded = np.zeros(len(text) + len(low), np.int64)
    padded[np.setdiff1d(np.arange(len(padded)), ends, assume_unique=True)] = text + 1
    length = FMIndex(padded).matching(query, np.cumsum(size[high]) - size[high], size[high])
    found[to[length >= WINDOW]] = True


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; a shard is as many groups as have INDEX_WORDS words."""
    held: list[tuple] = []
    words, group = 0, None

    def decided() -> Iterator[pa.RecordBatch]:
        groups, keys, seqs, docs = map(list, zip(*held))
        masks = match_sequences(groups, seqs, docs)
        yield from common.as_batches({"seq_key": keys, "lo": docs, "mask": [np.packbits(m).tobytes() for m in masks]}, _FOUND)

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("deal", "seq_key", "seq", "lo"))):
            if words >= INDEX_WORDS and row[0] != group:
                yield from decided()
                held, words = [], 0
            group = row[0]
            held.append(row)
            words += row[2].count(" ") + 2
    if held:
        yield from decided()


def _dealt(distinct: DataFrame, group: int) -> DataFrame:
    """``distinct`` with ``deal``, the group that a row is compared in: its anchor, or every pair of blocks with its own of a large anchor."""
    large = common.stored(distinct.groupBy("h").agg(F.ceil(F.count("*") / group).cast("int").alias("k")).filter("k > 1"), "large")
    calm = distinct.join(large.select("h"), "h", "left_anti").withColumn("deal", F.col("h"))
    i = F.pmod(F.xxhash64("seq_key"), F.col("k").cast("long")).cast("int")
    dealt = distinct.join(large, "h").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.withColumn("deal", F.xxhash64("h", F.least("i", "j"), F.greatest("i", "j")))
    return calm.unionByName(dealt.select(*calm.columns))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, sha, spans, texts = [], [], [], []
        for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
            w = text.encode().split()
            edge = np.zeros(len(w) + 1, np.int32)
            for f in found or []:
                on = np.ones(f["n"], bool) if f["mask"] is None else np.unpackbits(np.frombuffer(f["mask"], np.uint8), count=f["n"]).astype(bool)
                at = f["start"] + np.flatnonzero(on)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([x for x, g in zip(w, gone.tolist()) if not g])
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(kept).hexdigest())
            step = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"first": int(i), "last": int(j)} for i, j in zip(step[::2], step[1::2])])
            texts.append(kept.decode())
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, span), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])


def remove_repeats(docs: DataFrame, hot_rows: int = HOT_ROWS, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges) and kept (null where nothing can repeat) of (doc_id, text) rows."""
    common.prepare(docs.sparkSession)
    parts = common.partitions(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    runs = candidate_runs(docs.filter("doc_id is not null and text is not null"), hot_rows)
    # A row has at most one entry for each of its windows.
    runs = common.stored(runs.groupBy("row_key").agg(F.collect_list(F.struct("h", "starts", "n")).alias("runs")), "candidates")
    kind = "doc_id long, row_key long, runs array<struct<h:long,starts:array<int>,n:int>>, text string, n_words long, kept_sha256 string"
    base = common.stored(docs.join(runs, "row_key", "left").select("doc_id", "row_key", "runs", "text").mapInArrow(_plain, kind), "base")
    open_rows = base.filter("kept_sha256 is null")
    seqs = common.stored(open_rows.mapInArrow(_sequences, "row_key long, doc_id long, h long, start int, n int, seq_key binary, seq string"), "sequences")
    distinct = common.stored(seqs.groupBy("h", "seq_key", "seq").agg(F.min("doc_id").alias("lo")), "distinct")
    shards = _dealt(distinct, group).repartition(parts, "deal").sortWithinPartitions("deal", "seq_key")
    found = common.stored(shards.select("deal", "seq_key", "seq", "lo").mapInArrow(_shard, "seq_key binary, lo long, mask binary"), "found")
    hits = seqs.drop("seq").join(found, "seq_key").select("row_key", F.struct("start", "n", F.when(F.col("doc_id") <= F.col("lo"), F.col("mask")).alias("mask")).alias("f"))
    hits = common.stored(hits.groupBy("row_key").agg(F.collect_list("f").alias("found")), "hits")
    done = open_rows.join(hits, "row_key", "left").select("doc_id", "n_words", "text", "found").mapInArrow(
        _strip, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>, kept string"
    )
    rest = base.filter("kept_sha256 is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.array().cast("array<struct<first:int,last:int>>").alias("spans"), F.lit(None).cast("string").alias("kept"))
    return rest.unionByName(done)


def op1_fm_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
