"""Language identification by cross-parsing entropy.

One suffix automaton for each language holds a bounded reference of labelled text.  A text is
parsed greedily into longest matches against every automaton; a phrase ends where the automaton has
no next step.  With n the parsed length, a language costs phrases * log2(reference length) / n bits a
character, and the cheapest wins.

Text is lower-cased UTF-8; runs of bytes that are not letters count as one space.  Whole texts are
parsed, each as one sequence: the pieces of ``LANE`` bytes that share vector lanes are parsed ahead from the start state, and
then taken up by the true state of the piece before until the two states agree, so LANE never changes a result.

The reference of a language is the whole texts of at most ``SAMPLE_DOCS`` labelled rows, in the order of a hash of
the doc_id, as far as they fit into ``REFERENCE_BYTES`` (less where many languages share ``TOTAL_BYTES``); rows that do not
fit are passed over.  A language whose every text is longer is learned from its shortest one.

A text ``fits`` where its cost is at most that of spelling it out, log2(alphabet) bits a symbol, with SLACK phrases to
spare, so that short texts are not held to it: what no learned language describes better is in none of them.

Defined results: null text and text without a letter give ``und``, score 0 and do not fit; where no language was
learned every text gives ``und``; equal costs go to the first language in alphabetical order; the
score is 1 - best cost / second cost (1 where one language was learned).  Repeated rows are
scored alike.  Empty tables give no rows.  Columns of the input stay; ``lang_pred``, ``score`` and ``fits`` replace
columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE_DOCS = 80
REFERENCE_BYTES = 40_000
TOTAL_BYTES = 400_000
LANE = 512
#: Pieces that are parsed side by side.
BLOCK = 2_048
SLACK = 8
UNKNOWN = "und"
LETTER = r"\p{L}"


class Model(NamedTuple):
    langs: list[str]
    #: Class of each byte; 0 is a space, -1 starts nothing.
    classes: np.ndarray
    width: int
    #: For each language the steps: (row of next state * width) << 2 | phrases ended.
    steps: list[np.ndarray]
    bits: list[float]


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[97:123] = np.arange(97, 123)
    kinds[128:] = np.arange(128, 256)
    return kinds


_KINDS = _byte_kinds()


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of lower-cased texts with each run of other bytes than letters as one 0."""
    off, raw = common.utf8(pc.utf8_lower(column.fill_null("") if column.null_count else column))
    kinds = _KINDS[raw]
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] != 0) | (kinds[:-1] != 0)
    cut = off[1:-1]
    keep[cut[cut < len(keep)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return at[off], kinds[keep]


def automaton(codes: list[int], width: int) -> np.ndarray:
    """Step table of the suffix automaton of ``codes`` (values below ``width``)."""
    link, length, nxt = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nxt.append({})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                nxt.append(dict(nxt[q]))
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    # Without a next step a phrase ends, and the symbol starts the next one (or is one by itself).
    # At the root such a symbol is a phrase; elsewhere it also ends the phrase before it.
    start = np.full(width, 2, np.int32)
    for c, s in nxt[0].items():
        start[c] = (s * width) << 2 | 1
    table = np.tile(start, (len(nxt), 1))
    table[0] = 1
    for s, to in enumerate(nxt):
        for c, q in to.items():
            table[s, c] = (q * width) << 2
    return table.ravel()


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, reference_bytes: int = REFERENCE_BYTES) -> Model:
    """Learn from (doc_id, text, lang) rows with text that has a letter and a non-null lang.

    The driver gets at most ``sample_docs`` texts of at most ``reference_bytes`` bytes for each language.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    size = F.octet_length("text")
    found = sorted(rows.groupBy("lang").agg(F.min(size).alias("least")).collect())
    if not found:
        return Model([], np.zeros(256, np.int32), 1, [], [])
    langs = [r["lang"] for r in found]
    most = min(reference_bytes, max(500, TOTAL_BYTES // len(langs)))
    # Rows of one language may be most of the table: the k first by hash are kept in every partition before they meet.
    rank = F.struct(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), F.col("doc_id").cast("string").alias("id"))
    refs = []
    for lang, least in found:
        mine = rows.filter((F.col("lang") == lang) & (size <= max(most, least)))
        picked = mine.orderBy(rank if least <= most else size, rank).limit(sample_docs if least <= most else 1).select("text").collect()
        parts, room = [], most
        for (text,) in picked:
            folds = folded(pa.array([text]))[1]
            if len(folds) + 1 <= room or not parts:
                parts += [folds, np.zeros(1, np.uint8)]
                room -= len(folds) + 1
        refs.append(np.concatenate(parts))
    seen = np.unique(np.concatenate(refs))
    classes = np.full(256, len(seen) + 1, np.int32)
    classes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 2
    return Model(langs, classes, width, [automaton(classes[r].tolist(), width) for r in refs], [float(np.log2(len(r) + 1)) for r in refs])


def phrases(off: np.ndarray, codes: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Phrase counts, shape (languages, texts)."""
    sizes = np.diff(off)
    lanes = -(-sizes // LANE)
    owner = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = off[owner] + nth * LANE
    size = np.minimum(LANE, off[owner + 1] - start)
    out = np.zeros((len(steps), len(sizes)), np.int64)
    totals, ends = np.zeros((len(steps), len(owner)), np.int64), np.zeros(len(steps), np.int64)
    for i in range(0, len(owner), BLOCK):
        part = slice(i, i + BLOCK)
        _block(start[part], size[part], nth[part], codes, steps, totals[:, part], ends)
        closing = i + np.flatnonzero(nth[part] == lanes[owner[part]] - 1)
        # The phrase that is open at the end of a text counts too.
        out[:, owner[closing]] += totals[:, closing] & 1
    if len(owner):
        totals >>= 1
        for k in range(len(steps)):
            out[k] += np.bincount(owner, totals[k], len(sizes)).astype(np.int64)
    return out


def _block(start: np.ndarray, size: np.ndarray, nth: np.ndarray, codes: np.ndarray, steps: list[np.ndarray], totals: np.ndarray, ends: np.ndarray) -> None:
    """Parse pieces that follow each other; ``totals`` gets 2 * phrases ended + whether one is open, ``ends`` carries states from block to block."""
    order = np.argsort(-size, kind="stable")
    first, sized = start[order], size[order]
    longest = int(sized[0])
    active = np.searchsorted(-sized, -np.arange(longest), side="left")
    grid = codes[np.minimum(first[None, :] + np.arange(longest)[:, None], len(codes) - 1)]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    later = np.flatnonzero(nth > 0).tolist()
    begin, length, column, code = start.tolist(), size.tolist(), place.tolist(), memoryview(codes)
    states, counts = np.zeros((longest, len(order)), np.int32), np.zeros((longest, len(order)), np.int32)
    for k, table in enumerate(steps):
        row, ended = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        for t in range(longest):
            n = active[t]
            v = table[row[:n] + grid[t, :n]]
            ended[:n] += v & 3
            row[:n] = v >> 2
            states[t], counts[t] = row, ended
        total, last = ended[place].tolist(), row[place].tolist()
        step, seen, upto = memoryview(table), memoryview(states), memoryview(counts)
        for lane in later:
            state, count, c, at = last[lane - 1] if lane else int(ends[k]), 0, column[lane], begin[lane]
            for t in range(length[lane]):
                v = step[state + code[at + t]]
                count += v & 3
                state = v >> 2
                if state == seen[t, c]:
                    # From here on both parses are one.
                    count += total[lane] - upto[t, c]
                    state = last[lane]
                    break
            total[lane], last[lane] = count, state
        totals[k] = np.array(total) * 2 + (np.array(last) != 0)
        ends[k] = last[-1]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and fits."""
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.drop("lang_pred", "score", "fits")
    flag = common.free_name(docs, "has_letter")
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fits", T.BooleanType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = b.column("text")
            off, kinds = folded(text)
            sizes = np.diff(off)
            best, score, fits = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes), bool)
            has = np.array(b.column(flag).fill_null(False))
            if m.langs:
                cost = phrases(off, m.classes[kinds], m.steps) * np.array(m.bits)[:, None] / np.maximum(sizes, 1)
                best = cost.argmin(0)
                fits = (cost.min(0) - np.log2(m.width)) * sizes <= SLACK * np.array(m.bits)[best]
                if len(m.langs) > 1:
                    two = np.partition(cost, 1, axis=0)
                    score = np.where(two[1] > 0, 1 - two[0] / np.where(two[1] > 0, two[1], 1), 0)
                else:
                    score = np.ones(len(sizes))
            has &= bool(m.langs)
            pred = [m.langs[i] if ok else UNKNOWN for i, ok in zip(best, has)]
            b = b.drop_columns([flag])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(np.where(has, np.clip(score, 0, 1), 0.0)), pa.array(has & fits)], [*b.schema.names, "lang_pred", "score", "fits"])

    return docs.withColumn(flag, F.col("text").rlike(LETTER)).mapInArrow(parse, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
