"""Alignment of two tokenizers' tokens over the same text by byte-owner arrays.

Tokens of A and B cover the same bytes.  ``np.repeat`` of the token numbers by their byte lengths gives the owner of every byte on each side;
where the pair of owners changes a new overlap begins, and where both change at once both sides have a cut.  So overlaps (links) and
groups between common cuts come from two arrays of the text's length, whatever the tokenizers are.

Both tokenizers split before a space whose neighbours are not white space, and neither joins across it (checked when they are loaded), so a text is cut
there first: the tokens of its pieces are those of the whole, and equal pieces are encoded and aligned once in a worker.  Pieces are kept in
two generations of bounded size; long pieces are not kept.

For each document its distinct linked id pairs are stored with their numbers of occurrences.  A pair's count is the number of documents
that hold it.  Counts come back to the documents by a join: pairs with at least a ``FREQUENT``-th part of all rows number at most ``FREQUENT``
and are broadcast, the others are joined by shuffle, where none of them has more than that part of the rows.

Defined results: null and empty texts, and texts whose tokens of either side do not give back the bytes of space + text, have no tokens
and count for no pair; repeated rows, and rows without a doc_id, are documents of their own; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pieces in a generation of a worker's cache, and characters of the longest piece that is kept.
CACHE_PIECES = 100_000
KEPT_CHARS = 64
#: Pieces that are encoded and aligned together.
PART_PIECES = 4096
#: Bound of the rows of the pair table that are broadcast.
FREQUENT = 500_000

_CUT = re.compile("(?<=[^\\s\u180e])(?= [^\\s\u180e])")


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, whether both begin there) of every overlap in order, from the byte lengths of tokens that cover the same bytes."""
    own_a, own_b = np.repeat(np.arange(len(a)), a), np.repeat(np.arange(len(b)), b)
    if len(own_a) != len(own_b):
        raise ValueError("tokens cover different numbers of bytes")
    if not len(own_a):
        return own_a, own_b, np.zeros(0, bool)
    new_a, new_b = np.diff(own_a, prepend=-1) != 0, np.diff(own_b, prepend=-1) != 0
    at = np.flatnonzero(new_a | new_b)
    return own_a[at], own_b[at], (new_a & new_b)[at]


class ByteLevel:
    """Ids and token bytes of a byte-level BPE of the tokenizers library; special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        rules = json.loads(self.tok.to_str())
        before = rules.get("pre_tokenizer") or {}
        self.splits = not rules.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not rules["model"].get("dropout")
        # The byte alphabet: printable bytes stand for themselves, the others for the characters from 256 on in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in self.tok.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in t)}
        self.bytes_of = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.feed = self.ids("\n")

    def ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """Ids and token bytes of a sentencepiece model that puts a space before a text; texts are given with that space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(re.search("[^▁]▁", p) for p in names)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        # A line feed is a token that no other piece holds.
        self.feed = [i for i, b in enumerate(self.bytes_of) if b == b"\n"] if sum(b"\n" in b for b in self.bytes_of) == 1 else []

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text[1:])


def _plain(piece: str) -> bool:
    """Whether a piece has no white space but its first character; a line feed at its end would run into the one after it."""
    return piece[1:].split() == [piece[1:]] and "\u180e" not in piece


#: (tokens of A, tokens of B, groups, groups as text, pair of ids of each link), None where bytes differ.
Aligned = tuple[int, int, int, bytes, bytes] | None


class Aligner:
    """Alignments of whole texts, with those of their pieces worked out once."""

    def __init__(self, a: str, b: str):
        self.sides = ByteLevel(a), Pieces(b)
        self.splits = all(x.splits for x in self.sides)
        self.sizes = [np.array([len(t) for t in x.bytes_of], np.int64) for x in self.sides]
        self.known: dict[str, Aligned] = {}
        self.older: dict[str, Aligned] = {}

    def _ids(self, side: ByteLevel | Pieces, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has.  Pieces without other white space go through one call, a line feed between two."""
        if len(side.feed) == 1 and all(map(_plain, pieces)):
            ids = np.array(side.ids("\n".join(pieces)), np.int64)
            at = np.flatnonzero(ids == side.feed[0])
            if len(at) == len(pieces) - 1:
                return np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1
        each = [side.ids(p) for p in pieces]
        return np.array(list(itertools.chain.from_iterable(each)), np.int64), np.array(list(map(len, each)), np.int64)

    def _align(self, pieces: list[str]) -> Iterator[tuple[str, Aligned]]:
        """Alignments of pieces that begin with a space, all by the same two owner arrays."""
        raw = [p.encode() for p in pieces]
        long = np.array(list(map(len, raw)), np.int64)
        ids, counts, ok = [], [], np.ones(len(pieces), bool)
        for side, size in zip(self.sides, self.sizes):
            i, n = self._ids(side, pieces)
            got = np.zeros(len(pieces), np.int64)
            np.add.at(got, np.repeat(np.arange(len(n)), n), size[i])
            ok &= got == long
            if b"".join(map(side.bytes_of.__getitem__, i.tolist())) != b"".join(raw):
                end = np.cumsum(n)
                ok &= [b"".join(map(side.bytes_of.__getitem__, i[e - k : e].tolist())) == r for e, k, r in zip(end.tolist(), n.tolist(), raw)]
            ids.append(i)
            counts.append(n)
        if not ok.all():
            yield from ((p, None) for p, good in zip(pieces, ok) if not good)
            ids = [i[np.repeat(ok, n)] for i, n in zip(ids, counts)]
            counts, pieces = [n[ok] for n in counts], [p for p, good in zip(pieces, ok) if good]
        (a, b), (n_a, n_b) = ids, counts
        x, y, cut = overlaps(self.sizes[0][a], self.sizes[1][b])
        owner = np.repeat(np.arange(len(pieces)), n_a)[x]
        n_links, n_groups = np.bincount(owner, minlength=len(pieces)), np.bincount(owner[cut], minlength=len(pieces))
        links = (a[x] << 32 | b[y]).tobytes()
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        p, q = x[cut].tolist(), y[cut].tolist()
        groups = [f"{text_a[i] if j - i == 1 else ','.join(text_a[i:j])}|{text_b[k] if m - k == 1 else ','.join(text_b[k:m])}" for i, j, k, m in zip(p, [*p[1:], len(a)], q, [*q[1:], len(b)])]
        g = l = 0
        for piece, i, j, k, m in zip(pieces, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist()):
            yield piece, (i, j, k, ";".join(groups[g : g + k]).encode(), links[8 * l : 8 * (l + m)])
            g, l = g + k, l + m

    def learn(self, pieces: set[str]) -> None:
        new = []
        for p in pieces:
            if p in self.older:
                self.known[p] = self.older[p]
            else:
                new.append(p)
        # Odd pieces apart, as one of them sends its whole part through single calls.
        for some in (list(filter(_plain, new)), [p for p in new if not _plain(p)]):
            for i in range(0, len(some), PART_PIECES):
                self.known.update(self._align(some[i : i + PART_PIECES]))

    def texts(self, texts: list[str | None]) -> list[list[Aligned]]:
        """Alignments of the pieces of space + text, in order; none of null and empty texts."""
        cut = [[] if not t else _CUT.split(" " + t) if self.splits else [" " + t] for t in texts]
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {}, self.known
        new = set().union(*cut) - self.known.keys()
        self.learn(new)
        out = [list(map(self.known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > KEPT_CHARS:
                del self.known[p]
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    """The aligner of this worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, tokenizers: tuple[str, str] | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of every row of ``docs`` (doc_id, text).

    ``pairs``: distinct linked ids, A's times 2^32 plus B's, and how often each is linked; with ``texts`` also ``groups`` as text.
    """
    common.prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), *([("groups", pa.string())] if texts else [])])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _aligner(*(tokenizers or default_tokenizers()))
        for b in batches:
            out: list[tuple] = []
            for got in both.texts(b.column("text").to_pylist()):
                if not got or None in got:
                    out.append((0, 0, 0, 0, "", [], [], ""))
                    continue
                n_a, n_b, n_groups, groups, links = zip(*got)
                whole, linked = b";".join(groups), np.frombuffer(b"".join(links), np.int64)
                pairs, times = np.unique(linked, return_counts=True)
                out.append((sum(n_a), sum(n_b), sum(n_groups), len(linked), hashlib.sha256(whole).hexdigest(), pairs, times, whole.decode() if texts else ""))
            cols = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    kind = f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, pairs array<long>, times array<long>" + (", groups string" if texts else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, kind)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of ``aligned`` a pair is linked, and whether no pair of its A id is in more."""
    n = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    n = common.stored(n.withColumn("a", F.shiftright("pair", 32)), "pairs")
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def token_links(docs: DataFrame, tokenizers: tuple[str, str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text).

    n_best: links whose pair's count is the highest of their A id, ties included; count_sum: the counts of all links added up.
    """
    rows = common.stored(aligned(docs, tokenizers).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = common.stored(pair_counts(rows), "counts")
    size = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("links")).first()
    # At most ``frequent`` pairs can have so many rows each.
    least = 0 if size["pairs"] <= frequent else -(-size["links"] // frequent)
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    links = each.join(F.broadcast(counts.filter(F.col("n") >= least)), "pair", "left")
    if least > 0:
        far = links.filter("n is null").drop("n", "best").join(counts.filter(F.col("n") < least).hint("merge"), "pair")
        links = links.filter("n is not null").unionByName(far)
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", *_COUNTS, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


def op11_byte_owner_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(common.table(spark, sf_dir, "documents"))
