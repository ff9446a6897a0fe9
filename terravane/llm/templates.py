"""Line dedup by a log-template tree.

Every line is parsed to a leaf of a tree of fixed depth: its token count, then its first ``DEPTH`` tokens,
with tokens that hold a digit masked as ``<*>``.  Within a leaf, the tokens of a line are ranked by the documents
that have them at their position.  A line has several templates: itself, and itself with its rarest tokens, those up
to some rank, as variable fields ``<*>``; at most ``MAX_VARIABLE`` of a template's tokens are variable, and one with
variable fields has at least ``MIN_TOKENS`` tokens.  As ranks only compare tokens of one line, a field stays variable however often its values
come back in a larger corpus.  Tokens that fewer than ``MIN_DOCS`` documents have are variable in every template, as no
recurring one can hold them.  A template that at least ``MIN_DOCS`` documents have is recurring, and its lines are
dropped from all of them.

Only leaves that ``MIN_DOCS`` documents reach go on past the first count, and documents with the same lines in a leaf are
counted before their tokens are dealt out, so a line that a third of all documents hold is one weighted row.  What recurs is decided
on distinct lines; line rows meet the decision last, those of hot lines dealt over several tasks.

Defined results: lines end at a line feed; tokens are runs of anything but ASCII white space; a line without
tokens is kept; null and empty texts have no lines and keep their text (null gives null); a document counts once for
a template however often it holds it; each of several equal rows counts as a document; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEPTH = 3
MIN_DOCS = 5
MIN_TOKENS = 3
MAX_VARIABLE = 0.34
WILD = "<*>"
#: Rows from which a line or a template is split over several tasks, and the most that are.
HOT_ROWS = 1_000
MAX_HOT = 20_000

#: Tokens with a digit; the look-behind only keeps the search from starting again within a token.
_DIGIT = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*")


def masked_lines(text: str) -> list[tuple[int, int, str]]:
    """(line number, leaf, masked tokens joined by a space) of every line with tokens."""
    out = []
    for i, line in enumerate(_DIGIT.sub(WILD, text).encode().split(b"\n")):
        tokens = line.split()
        if tokens:
            leaf = xxhash.xxh64_intdigest(b" ".join([b"%d" % len(tokens), *tokens[:DEPTH]])) - (1 << 63)
            out.append((i, leaf, b" ".join(tokens)))
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line rows; ``opens`` marks a text's first line of each leaf."""
    schema = pa.schema([("row_key", pa.int64()), ("line_no", pa.int32()), ("leaf", pa.int64()), ("opens", pa.bool_()), ("line", pa.string())])
    for b in batches:
        out: list[tuple] = []
        for key, text in zip(b.column("row_key").to_pylist(), b.column("text").to_pylist()):
            seen: set[int] = set()
            for i, leaf, line in masked_lines(text or ""):
                out.append((key, i, leaf, leaf not in seen, line))
                seen.add(leaf)
        cols = list(zip(*out)) or [()] * 5
        yield from common.as_batches({f.name: pa.array(c, pa.binary()).cast(pa.string()) if f.name == "line" else list(c) for f, c in zip(schema, cols)}, schema, 5_000)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, max_variable: float = MAX_VARIABLE) -> DataFrame:
    """(row_key, line_no, template, docs) of the lines to drop, a row for each recurring template, from rows (row_key, text)."""
    lines, decided, hot = _decided(docs, min_docs, min_tokens, max_variable)
    return _meet(lines, decided, hot, ["leaf", "line_id"], "row_key").select("row_key", "line_no", "template", "docs")


def _hot(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts) of the keys of counts (keys, n) that have too many rows for one task; at most ``MAX_HOT`` of them.

    The parts of all hot keys together are at most twice ``MAX_HOT``, as each but a key's last has ``limit`` rows.
    """
    limit = max(HOT_ROWS, -(-(counts.agg(F.sum("n")).first()[0] or 0) // MAX_HOT))
    return counts.filter(F.col("n") >= limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("parts"))


def _meet(many: DataFrame, few: DataFrame, hot: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join on ``keys``; rows of ``many`` with a hot key are dealt by ``by`` over its parts, each with its own copy from ``few``."""
    at = [k for k in keys if k in hot.columns]
    dealt = many.join(F.broadcast(hot), at, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    copies = few.join(F.broadcast(hot), at, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [*keys, "part"]).drop("part")


def _decided(docs: DataFrame, min_docs: int, min_tokens: int, max_variable: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line rows (row_key, line_no, leaf, line_id), recurring distinct lines (leaf, line_id, template, docs), and hot lines."""
    common.prepare(docs.sparkSession)
    raw = docs.select("row_key", "text").filter("text is not null").mapInArrow(_lines, "row_key long, line_no int, leaf long, opens boolean, line string")
    raw = common.stored(raw, "raw")
    leaves = raw.groupBy("leaf").agg(F.count_if("opens").alias("docs"), F.count("*").alias("n"))
    leaves = common.stored(leaves.filter(F.col("docs") >= min_docs), "leaves")
    large = common.stored(_hot(leaves, ["leaf"]), "large")
    lines = _meet(raw.drop("opens"), leaves.select("leaf"), large, ["leaf"], "row_key")
    lines = common.stored(lines.withColumn("line_id", F.xxhash64("leaf", "line")), "lines")
    distinct = common.stored(lines.groupBy("leaf", "line", "line_id").agg(F.count("*").alias("n")), "distinct")
    # Equal rows share a key; the rows over the line numbers are the number of such rows.  The lists are bounded by one document.
    held = lines.groupBy("leaf", "row_key").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.expr("count(*) div size(collect_set(line_no))").alias("n"))
    held = common.stored(held.groupBy("leaf", "lines").agg(F.sum("n").alias("n")), "held")
    at = lambda line: F.transform(F.split(line, " "), lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
    had = held.select("leaf", "n", F.explode(F.array_distinct(F.flatten(F.transform("lines", at)))).alias("at")).select("leaf", "n", "at.*").filter(F.col("token") != WILD)
    had = had.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("had")).filter(F.col("had") >= min_docs)
    tokens = distinct.select("leaf", "line_id", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    tokens = tokens.join(had, ["leaf", "pos", "token"], "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long")))
    # A line has as many rows here as it has tokens, so the lists are bounded by one line.
    ranked = tokens.groupBy("leaf", "line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "had"))).alias("parts"))
    ranks = F.transform("parts", lambda p: p["had"])
    # The lowest rank that is one variable field too many.
    over = F.coalesce(F.get(F.array_sort(ranks), F.floor(F.size("parts") * max_variable).cast("int")), F.lit((1 << 63) - 1))
    cuts = F.filter(F.array_union(F.array(F.lit(0).cast("long")), ranks), lambda r: (r < F.col("over")) & ((F.size("parts") >= min_tokens) | (r < F.array_min(ranks))))
    named_at = lambda cut: F.array_join(F.transform("parts", lambda p: F.when(p["had"] > cut, p["token"]).otherwise(F.lit(WILD))), " ")
    named = ranked.withColumn("over", over).select("leaf", "line_id", F.explode(F.transform(cuts, named_at)).alias("template"))
    named = common.stored(named.withColumn("template_id", F.xxhash64("template")), "named")
    # Documents are counted by their distinct sets of lines, and a set once for a template.
    hot = common.stored(_hot(distinct, ["leaf", "line_id"]), "hot")
    sets = held.select("leaf", F.xxhash64("leaf", "lines").alias("set_id"), "n", F.explode("lines").alias("line")).withColumn("line_id", F.xxhash64("leaf", "line")).drop("line")
    often = _meet(sets, named, hot, ["leaf", "line_id"], "set_id").groupBy("leaf", "template_id", "template", "set_id").agg(F.max("n").alias("n"))
    often = common.stored(often.groupBy("leaf", "template_id", "template").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= min_docs), "often")
    wide = common.stored(_hot(named.groupBy("leaf", "template_id").agg(F.count("*").alias("n")), ["leaf", "template_id"]), "wide")
    decided = _meet(named, often, wide, ["leaf", "template_id", "template"], "line_id").select("leaf", "line_id", "template", "docs")
    return lines.select("row_key", "line_no", "leaf", "line_id"), common.stored(decided, "decided"), hot


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, max_variable: float = MAX_VARIABLE) -> DataFrame:
    """``docs`` with text without its recurring lines, n_lines and n_dropped."""
    key = F.xxhash64("doc_id", "text")
    found, decided, hot = _decided(docs.select(key.alias("row_key"), "text"), min_docs, min_tokens, max_variable)
    drops = _meet(found, decided.select("leaf", "line_id").distinct(), hot, ["leaf", "line_id"], "row_key")
    drops = drops.groupBy(F.col("row_key").alias("_key")).agg(F.collect_set("line_no").alias("_gone"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("_gone"), i))
    gone = F.coalesce(F.size("_gone"), F.lit(0))
    out = docs.drop("n_lines", "n_dropped").withColumn("_row", key).join(drops, F.col("_row") == F.col("_key"), "left")
    return (
        out.withColumn("n_lines", F.when(F.coalesce(F.octet_length("text"), F.lit(0)) == 0, 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(gone).cast("long"))
        .withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop("_row", "_key", "_gone")
    )


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
