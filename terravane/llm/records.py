"""Length-delimited binary records of token ids, with a separate offset index.

Frame: u64 payload length, u32 masked CRC-32 of those 8 bytes, payload, u32 masked CRC-32 of the
payload, one byte 0x0A; all little-endian.  Payload: i64 doc_id, u8 width (2 or 4, plus 128 where the doc_id is null), ids of that width.
The mask is ((crc >> 15) | (crc << 17)) + 0xa282ead8, so that a checksum stored in data that is
itself checksummed stays sound.  The closing byte lets Spark's own file writer (task commit, any
Hadoop file system) end each frame; readers go by the lengths.

Files are cut in ascending doc_id order by range partitions of a target size, one task writes one
file.  The index (file, doc_id, seq, offset, length, n_tokens, ids_crc32, file_start) is a Parquet
table beside the data; ``read_records`` fetches any subset of it, in any order, for shuffled reads.

Defined results: null and empty texts give the end id alone; equal texts and repeated rows give a
frame each; rows with a null doc_id are stored first and come back with a null doc_id; an empty table
gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END_ID = 2
#: Bit of the width byte that says that there is no doc_id.
NO_ID = 128
#: Bytes of text a file holds.
FILE_TEXT_BYTES = 16 << 20
#: Pieces in a generation of a worker's encoder.
CACHE_PIECES = 700_000
#: About the characters of the texts whose pieces are looked up together.
GROUP_CHARS = 4 << 20

_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qB")
_TAIL = struct.Struct("<I")


def masked(crc: int) -> int:
    return ((((crc >> 15) | (crc << 17)) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = _BODY.pack(doc_id or 0, width | (NO_ID if doc_id is None else 0)) + ids.astype("<u2" if width == 2 else "<u4").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + _TAIL.pack(masked(zlib.crc32(size))) + payload + _TAIL.pack(masked(zlib.crc32(payload))) + b"\n"


def frames(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each frame; raises ValueError where a checksum or a length is wrong."""
    at, end, view = 0, len(content), memoryview(content)
    while at < end:
        if at + 12 > end:
            raise ValueError(f"truncated frame header at {at}")
        n, crc = _HEAD.unpack_from(view, at)
        if masked(zlib.crc32(view[at : at + 8])) != crc:
            raise ValueError(f"length checksum at {at}")
        body = at + 12
        if body + n + 5 > end:
            raise ValueError(f"truncated frame at {at}")
        if masked(zlib.crc32(view[body : body + n])) != _TAIL.unpack_from(view, body + n)[0]:
            raise ValueError(f"payload checksum at {at}")
        doc_id, width = _BODY.unpack_from(view, body)
        doc_id, width = None if width & NO_ID else doc_id, width & ~NO_ID
        ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", (n - 9) // width, body + 9)
        yield at, n + 17, doc_id, ids
        at = body + n + 5


def _distinct(numbers: np.ndarray, n: int) -> np.ndarray:
    """Which of 0 to n - 1 occur, ascending."""
    seen = np.zeros(n, bool)
    seen[numbers] = True
    return np.flatnonzero(seen)


class Encoder:
    """Ids of whole texts by the tokenizers library, with the pieces between spaces encoded once.

    A byte-level pre-tokenizer that splits words with their leading space never joins text across a
    space or a line feed whose two neighbours are not white space, so a text is cut before each of
    those, and the ids of its pieces are those of the whole.  Texts with any other white space are
    cut only at single spaces between two non-white characters.

    That holds for a byte-level BPE without normaliser, prefix space or other rules (``splits``); with any other
    tokenizer whole texts are encoded.

    Pieces are kept in two generations of bounded size: what was met since the last change of
    generation stays.
    """

    cut = re.compile("(?<=[^\\s\u180e])(?= [^\\s\u180e])")
    #: A piece, perhaps with the line feed that it opens, without any other white space.
    clean = staticmethod(re.compile("\n?[^\\s\u180e]+").fullmatch)

    #: A piece of letters alone is one word of the pre-tokenizer, so the library's model can have it without the rest of the library.
    letters = staticmethod(re.compile("\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+").fullmatch)
    #: The pre-tokenizer's characters of bytes that are not printable ones, by Latin-1 character.
    signs = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.wide = 4 if self.tok.get_vocab_size() > 65536 else 2
        self.kind = np.uint16 if self.wide == 2 else np.uint32
        #: By piece without its leading space; pieces that open a line have their line feed.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.splits = self._splits()
        self.model = self.tok.model
        self.code = "H" if self.wide == 2 else "I"

    def _splits(self) -> bool:
        rules = json.loads(self.tok.to_str())
        before, model = rules.get("pre_tokenizer") or {}, rules["model"]
        plain = not rules.get("normalizer") and not rules.get("truncation") and not any(t["content"].strip() != t["content"] or not t["special"] for t in rules.get("added_tokens", []))
        level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        return bool(plain and level and model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token"))

    @staticmethod
    def all_clean(pieces: list[str]) -> bool:
        """Whether all pieces are clean, in one pass over all of them."""
        stems = [p[1:] if p[:1] == "\n" else p for p in pieces]
        text = " ".join(stems)
        return text.split() == stems and "\u180e" not in text

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: set[str]) -> None:
        new, late, known = [], [], self.known
        for p in pieces:
            if (got := self.older.get(p)) is not None:
                known[p] = got
            # A stop or comma after an ASCII letter is cut off by the pre-tokenizer.
            elif len(p) > 2 and p[-1] in ".," and p[-2].isascii() and p[-2].isalpha():
                stem = p[:-1]
                late.append(p)
                if stem not in known and stem not in pieces:
                    if (got := self.older.get(stem)) is None:
                        new.append(stem)
                    else:
                        known[stem] = got
            else:
                new.append(p)
        if late:
            new = list(dict.fromkeys(new))
            self._encode(new)
            stops = dict(zip(".,", self.whole([".", ","])))
            for p in late:
                known[p] = known[p[:-1]] + stops[p[-1]]
        else:
            self._encode(new)

    def word(self, word: str, space: bool) -> bytes:
        """Ids of a word of letters, with the space before it or without."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.signs)
        return array(self.code, [t.id for t in self.model.tokenize("\u0120" + word if space else word)]).tobytes()

    def _encode(self, new: list[str]) -> None:
        rest, feed = [], array(self.code, self.feed).tobytes()
        for p in new:
            if not self.letters(p):
                rest.append(p)
            elif p[0] == "\n":
                self.known[p] = feed + self.word(p[1:], False)
            else:
                self.known[p] = self.word(p, True)
        self._encode_mixed(rest)

    def _encode_mixed(self, new: list[str]) -> None:
        if len(self.feed) != 1:
            self.known.update(zip(new, self.whole([p if p[:1] == "\n" else " " + p for p in new])))
            return
        # A line feed between two pieces is one id of its own, so one call encodes many pieces.
        mark = self.feed[0]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            text = "\n".join(p[1:] if p[:1] == "\n" else " " + p for p in part)
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(ids == mark)
            if len(at) != len(part) - 1:
                self.known.update(zip(part, self.whole([p if p[:1] == "\n" else " " + p for p in part])))
                continue
            raw, w = ids.tobytes(), self.wide
            feed = ids.dtype.type(mark).tobytes()
            for p, a, b in zip(part, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]):
                self.known[p] = feed + raw[a * w : b * w] if p[:1] == "\n" else raw[a * w : b * w]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.splits:
            return [np.frombuffer(x, self.kind) for x in self.whole(texts)]
        # Long texts go in smaller groups, which bounds the arrays over a group's pieces.
        group = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // GROUP_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        return [ids for a, b in zip(cuts, cuts[1:]) for ids in self._encode_group(texts[a:b])]

    def _encode_group(self, texts: list[str]) -> list[np.ndarray]:
        # Pieces are split and made distinct by Arrow; Python sees each of a batch once.
        parts = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        off = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.dictionary_encode()
        # No piece holds a space, and one long string is read far faster than each by itself.
        every = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        names = pc.binary_join(every, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(coded.dictionary) else []
        at = coded.indices.to_numpy().astype(np.int64)
        text_of = np.repeat(np.arange(len(texts)), np.diff(off))
        inner = np.ones(len(at), bool)
        inner[off[:-1]] = False
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {}, self.known
        # Single spaces and line feeds are all the white space of a text that splits alike by both.
        heads = [names[i] for i in at[off[:-1]].tolist()]
        odd = np.array([t != "" and not self.clean(h) for t, h in zip(texts, heads)], bool)
        new = [i for i in _distinct(at[inner], len(names)).tolist() if names[i] not in self.known]
        if not self.all_clean([names[i] for i in new]):
            bad = np.zeros(len(names), bool)
            bad[[i for i in new if not self.clean(names[i])]] = True
            odd[text_of[inner & bad[at]]] = True
        inner &= ~odd[text_of]
        used = _distinct(at[inner], len(names))
        pieces = [names[i] for i in used.tolist()]
        self.learn({p for p in pieces if p not in self.known})
        first = dict(zip(own := list({h for h, o in zip(heads, odd.tolist()) if h and not o}), self.whole(own)))
        first[""] = b""
        # The ids of the distinct pieces in one array; a text's ids are gathered from it.
        raw = list(map(self.known.__getitem__, pieces))
        size = np.zeros(len(names), np.int64)
        size[used] = np.fromiter(map(len, raw), np.int64, len(raw)) // self.wide
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(raw), self.kind)
        n = np.where(inner, size[at], 0)
        end = np.cumsum(n)
        ids = flat[np.repeat(start[at] - end + n, n) + np.arange(end[-1] if len(end) else 0)]
        ends = np.concatenate([[0], end])[off].tolist()
        rare = iter(self.odd_texts([t for t, o in zip(texts, odd.tolist()) if o]))
        out: list[np.ndarray] = []
        for h, o, a, b in zip(heads, odd.tolist(), ends, ends[1:]):
            out.append(np.frombuffer(next(rare), self.kind) if o else np.concatenate([np.frombuffer(first[h], self.kind), ids[a:b]]))
        return out

    def odd_texts(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut.split(t) for t in texts]
        parts = list({p for ps in cut for p in ps})
        ids = dict(zip(parts, self.whole(parts)))
        return [b"".join([ids[p] for p in ps]) for ps in cut]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str | None) -> Encoder:
    """The encoder of this worker process, with the pieces that it has met in earlier tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    path = path or default_tokenizer()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, file_text_bytes: int = FILE_TEXT_BYTES) -> None:
    """Tokenise ``docs`` and write the record files below ``path``/data."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    n = max(1, -(-total // file_text_bytes), min(cores, total >> 20))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        end = np.array([END_ID], enc.kind)
        for b in batches:
            ids = enc.encode([t or "" for t in b.column("text").to_pylist()])
            made = [frame(d, np.concatenate([x, end]), enc.wide) for d, x in zip(b.column("doc_id").to_pylist(), ids)]
            # Typed as a string only because Spark's line writer takes strings; it writes the bytes as they are and adds the closing byte.
            yield pa.RecordBatch.from_arrays([pa.array([f[:-1] for f in made], pa.binary()).view(pa.string())], ["value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(encode, "value string").write.option("lineSep", "\n").text(f"{path}/data")


def file_order(name: Column) -> Column:
    """Place of a file among all: the number of the partition that wrote it, as a number (names grow wider from 100,000 files on)."""
    return F.regexp_extract(name, r"^part-([0-9]+)", 1).cast("long")


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back, verify each frame, write and return the offset index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("before", pa.int64())])
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                name, out, before = name.rpartition("/")[2], [], 0
                for seq, (at, size, doc_id, ids) in enumerate(frames(content.as_buffer())):
                    out.append((doc_id, seq, at, size, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                    before += len(ids)
                cols = list(zip(*out)) or [()] * 7
                yield from common.as_batches({"file": [name] * len(out)} | dict(zip(schema.names[1:], map(list, cols))), schema)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is a whole file
    files = spark.read.format("binaryFile").load(f"{path}/data").select("path", "content")
    index = files.mapInArrow(scan, "file string, doc_id long, seq long, offset long, length long, n_tokens long, ids_crc32 long, before long")
    index.write.parquet(f"{path}/index")
    common.prepare(spark)
    index = spark.read.schema(index.schema).parquet(f"{path}/index")
    # One row for each file: where its first id stands in the whole sequence.
    sizes = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    sizes = sizes.select("file", (F.sum("n").over(Window.orderBy(file_order(F.col("file")), "file")) - F.col("n")).alias("file_start"))
    return index.join(sizes, "file").withColumn("start", F.col("file_start") + F.col("before")).drop("before")


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the frames that ``wanted`` (file, offset, length) names, e.g. a shuffled part of the index."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column("at").to_pylist(), b.column("content")):
                view, out = memoryview(content.as_buffer()), []
                for x in at:
                    out += [(d, i.tolist()) for _, _, d, i in frames(bytes(view[x["offset"] : x["offset"] + x["length"]]))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([i for _, i in out], pa.list_(pa.int32()))], ["doc_id", "ids"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    files = spark.read.format("binaryFile").load(f"{path}/data").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("at")), "file").select("content", "at").mapInArrow(fetch, "doc_id long, ids array<int>")


def encode_records(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Write, verify and index: file, doc_id, seq, offset, length, n_tokens, ids_crc32, file_start, start."""
    spark = docs.sparkSession
    common.prepare(spark)
    path = path or common.new_path(spark, "records")
    write_records(docs, path, tokenizer, file_text_bytes)
    return index_records(spark, path)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_records(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")
