"""Importance resampling towards a target: hashed runs of words, log ratios of their buckets, and a draw without replacement.

A feature is a run of 1 to ``longest`` consecutive words; words are runs of ASCII letters (lower-cased) and digits and of all characters
beyond ASCII.  Its bucket is the CRC-32 of the run's UTF-8 bytes (words joined by one space) modulo ``buckets``.  Every partition keeps
a trie whose edges are words and whose nodes hold the CRC state of their path, so a run's CRC goes on from that of its prefix and is
worked out once for each distinct run of the partition.  In the first pass nodes count; their counts are added up by bucket, and
bucket totals (at most ``buckets`` rows) are all that leaves the partitions.  In the second pass nodes hold the gain of their bucket,
and a document's weight is the floored mean of the gains along its paths.  A trie that has grown to ``NODES`` nodes gives its
counts away and starts anew, so memory is bounded and nothing is lost.

Documents of at least ``least_words`` words are then ordered by weight plus Gumbel noise that the document's id fixes; the best
``percent`` of them are drawn.  The order is a range shuffle; no task or driver gets more than a row count of each partition.

Defined results: null and empty texts have no features and weight 0; a null doc_id draws its noise as the text ``null``; repeated rows
count and are ranked each by itself; equal scores go by doc_id; an empty table gives an empty result, and without target texts all
target counts are 0; other columns of the tables are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sharding

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Nodes of a trie before it starts anew.
NODES = 300_000
#: Words of a text that are walked at once.
STEP = 1 << 16

#: Lower-cases A-Z, keeps a-z, digits and bytes beyond ASCII, and makes all else a space.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_CLEAN).split() if text else []


class _Edges(dict):
    """Edges of one node: a word that is met first gets a new node, whose CRC goes on from the one here."""

    def __init__(self, trie: WordTrie, node: int):
        self.trie, self.state = trie, zlib.crc32(b" ", trie.crc[node]) if node else 0

    def __missing__(self, word: bytes) -> int:
        self[word] = node = self.trie.add(zlib.crc32(word, self.state))
        return node


class WordTrie:
    """Runs of words as paths from node 0."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS, gains: list[int] | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.crc, self.gain = [0], [0]
        self.edges: dict[int, _Edges] = {}
        self.counts = np.zeros(0, np.int64)

    def add(self, crc: int) -> int:
        self.crc.append(crc)
        if self.gains is not None:
            self.gain.append(self.gains[crc % self.buckets])
        return len(self.crc) - 1

    def children(self, node: int) -> _Edges:
        if (got := self.edges.get(node)) is None:
            got = self.edges[node] = _Edges(self, node)
        return got

    def paths(self, words: list[bytes]) -> Iterator[list[int]]:
        """Nodes of all runs of one length, for each length in turn."""
        at = list(map(self.children(0).__getitem__, words))
        yield at
        for k in range(1, self.longest):
            at = [self.children(n)[w] for n, w in zip(at, itertools.islice(words, k, None))]
            yield at

    def count(self, nodes: list[int]) -> None:
        got = np.bincount(np.array(nodes, np.int64), minlength=len(self.crc))
        got[: len(self.counts)] += self.counts
        self.counts = got

    def totals(self) -> dict[str, np.ndarray]:
        """Counts by bucket, and a new start."""
        bucket = np.array(self.crc, np.int64) % self.buckets
        total = np.zeros(self.buckets, np.int64)
        np.add.at(total, bucket[: len(self.counts)], self.counts)
        self.clear()
        held = np.flatnonzero(total)
        return {"bucket": held, "n": total[held]}


def nodes(trie: WordTrie, words: list[bytes]) -> Iterator[list[int]]:
    """Nodes of all runs of a text, in parts: a part has the runs that start at STEP words, and sees the ``longest`` - 1 words after them."""
    for i in range(0, len(words), STEP):
        yield list(itertools.chain.from_iterable(at[:STEP] for at in trie.paths(words[i : i + STEP + trie.longest - 1])))


def bucket_totals(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (text) fall into each bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, size = WordTrie(longest, buckets), [], 0
        for b in batches:
            for text in b.column("text").cast(pa.binary()).to_pylist():
                for at in nodes(trie, words_of(text)):
                    held.append(at)
                    size += len(at)
                    if size > STEP * 8:
                        trie.count(list(itertools.chain.from_iterable(held)))
                        held, size = [], 0
                        if len(trie.crc) > NODES:
                            yield from common.as_batches(trie.totals(), schema)
        trie.count(list(itertools.chain.from_iterable(held)))
        yield from common.as_batches(trie.totals(), schema)

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """The log ratio of target and source for each bucket, in thousandths rounded down, with one added to every count."""
    b = float(len(source))
    s_all, t_all = float(source.sum()) + b, float(target.sum()) + b
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, rounded down, that the id fixes."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, by_bucket: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, row_key, n_words, n_features, weight and score of each row of ``docs`` (doc_id, text); row_key is the hash of both."""
    gain = docs.sparkSession.sparkContext.broadcast(by_bucket)  # a number for each bucket
    schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "row_key", "n_words", "n_features", "weight", "score")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(longest, len(gain.value), gain.value)
        for b in batches:
            out = []
            for doc_id, key, text in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                words, n, total = words_of(text), 0, 0
                for at in nodes(trie, words):
                    n += len(at)
                    total += sum(map(trie.gain.__getitem__, at))
                weight = total // n if n else 0
                out.append((doc_id, key, len(words), n, weight, weight + noise(doc_id, seed)))
                if len(trie.crc) > NODES:
                    trie.clear()
            yield from common.as_batches(dict(zip(schema.names, map(list, zip(*out)))) if out else dict.fromkeys(schema.names, []), schema)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return keyed.mapInArrow(score, "doc_id long, row_key long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, row_key, n_words, n_features, weight, score and rank (null where not drawn) of every row of ``docs`` (doc_id, text)."""
    common.prepare(docs.sparkSession)
    by_bucket = gains(bucket_totals(docs, longest, buckets), bucket_totals(target, longest, buckets))
    rows = common.stored(scored(docs, by_bucket, longest, seed), "scored")
    able = rows.filter(F.col("n_words") >= least_words).withColumn("falling", -F.col("score"))
    able = sharding.ranked(able, ["falling", "doc_id", "n_features", "weight", "row_key"], "order")
    drawn = F.when(F.col("rank") < F.expr(f"(total * {percent}) div 100"), F.col("rank") + 1)
    kept = [*rows.columns]
    out = able.select(*kept, drawn.alias("rank"))
    return out.unionByName(rows.filter(F.col("n_words") < least_words).select(*kept, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows equal in doc_id and text go together."""
    rows, key = resample(docs, target, **options).filter("rank is not null"), common.free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return keyed.join(rows.select(F.col("row_key").alias(key)).distinct(), key, "left_semi").select(*docs.columns)


def op12_word_trie_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
