"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window is ``WINDOW`` consecutive words
of an item; an item of fewer words, but not none, is one window.  Of every ``WINDOW`` consecutive words the smallest
hash (by its leading 33 bits, leftmost on ties) of their ``GRAM``-word grams is kept as a fingerprint, with its position, on both sides.  Equal windows have
equal smallest grams at equal offsets, so every shared window is met in the join of the fingerprints.  A gram that many
documents and items have would give every pair of them; so only meetings count whose SIDE words before, or after, the gram agree
as well, as those of a shared window do on one side at least.  Each meeting is extended word by word to both sides on the texts themselves, and runs as long as a window are hits.

Items shorter than a window have one fingerprint for each of their lengths that occurs (at most WINDOW - 1
lengths): the hash of all their words, joined with every run of that length.  Fingerprints of all kinds come from one
pass over the texts.

Defined results: null and empty texts have no words and no hits; an item without words is never hit; an item_id that
is null counts as no item; equal items are all listed; repeated rows get equal results; empty tables give no rows
(documents) or no hits (benchmark).  Other columns of both tables are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
GRAM = 5
#: Half of the words of a window beside its gram, rounded up.
SIDE = (WINDOW - GRAM + 1) // 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Array of the words of ``text``.  Spark's lower() agrees with A-Z lowering on ASCII and is far faster there."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.filter(F.split(F.coalesce(low, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words ``text`` has: as many as when capitals, instead of being lower-cased, are word characters."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once: the optimiser would copy it into the inner lambdas."""
    return F.transform(F.array(value), body)[0]


def run_hash(codes: Column, at: Column, k: int) -> Column:
    """Hash of the k codes from ``at`` on, which must be there: elements one by one, as a slice copies them through a Scala view."""
    return F.xxhash64(*(F.get(codes, at + j if j else at) for j in range(k)))


def gram_hashes(words: Column, k: int) -> Column:
    """Hash of each run of k consecutive word codes, by position; empty where there are fewer."""
    return bound(words, lambda w: F.transform(_starts(F.size(w) - k + 1), lambda i: run_hash(w, i, k)))


def _starts(n: Column, least: int = 1) -> Column:
    """0 to n - 1; empty where n is below ``least``."""
    return F.when(n >= least, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


#: Low bits that hold a gram's position where grams are ordered by hash and then by position.
_PLACE = (1 << 31) - 1


def winnowed(codes: Column, window: int = WINDOW - GRAM + 1) -> Column:
    """Positions of the grams that are the smallest, leftmost on ties, of some run of ``window`` grams."""

    def selected(c: Column) -> Column:
        starts = _starts(F.size(c) - GRAM + 1, window)
        return bound(F.transform(starts, lambda i: run_hash(c, i, GRAM).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i)), by_half)

    # The smallest of a run is that of two runs of half the length, which overlap if it is odd; least() skips what lies behind the end.
    half = (window + 1) // 2

    def by_half(keyed: Column) -> Column:
        return bound(F.transform(keyed, lambda x, i: F.least(x, *(F.get(keyed, i + j) for j in range(1, half)))), by_window)

    def by_window(low: Column) -> Column:
        whole = F.slice(low, 1, F.greatest(F.size(low) - window + 1, F.lit(0)))
        found = F.transform(whole, lambda x, i: F.least(x, F.get(low, i + window - half)))
        return F.transform(F.array_distinct(found), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int"))

    return bound(codes, selected)


def fingerprints(words: Column, lengths: list[int], whole: bool = False) -> Column:
    """array<(n, pos, hash, before, after)>: winnowed grams with the hashes of the words beside them (n = WINDOW), and runs of each of the lengths.

    With ``whole`` runs are those that are all words.
    """

    def run_of(codes: Column, n: int) -> Column:
        runs = gram_hashes(codes, n)
        if whole:
            runs = F.when(F.size(codes) == n, runs).otherwise(F.array().cast("array<bigint>"))
        none = F.lit(None).cast("long")
        return F.transform(runs, lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("pos"), h.alias("hash"), none.alias("before"), none.alias("after")))

    def kinds(codes: Column) -> Column:
        prints = F.transform(winnowed(codes), lambda p: F.struct(
            F.lit(WINDOW).alias("n"), p.alias("pos"), run_hash(codes, p, GRAM).alias("hash"),
            F.when(p >= SIDE, run_hash(codes, p - SIDE, SIDE)).alias("before"),
            F.when(p + GRAM + SIDE <= F.size(codes), run_hash(codes, p + GRAM, SIDE)).alias("after")))
        return F.concat(prints, *(run_of(codes, n) for n in lengths))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), kinds)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row_key, spans, item_ids) of the documents with hits, from docs (row_key, text) and items (item_id, text).

    ``spans`` are [first, last) word ranges, merged; ``item_ids`` those of all items with an occurring window.
    """
    words = words_of(F.col("text")).alias("words")
    items = items.filter("item_id is not null").select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("item_words"))
    items = common.stored(items.filter(F.size("item_words") > 0), "items")
    # At most WINDOW - 1 rows, whatever the size of the tables.
    lengths = sorted(r[0] for r in items.filter(F.size("item_words") < WINDOW).select(F.size("item_words")).distinct().collect())

    mine = docs.select("row_key", words).select("row_key", F.inline(fingerprints(F.col("words"), lengths)))
    theirs = items.select("item", F.inline(fingerprints(F.col("item_words"), lengths, whole=True)))
    theirs = theirs.withColumnsRenamed({"pos": "item_pos", "before": "item_before", "after": "item_after"})
    agree = (F.col("n") < WINDOW) | F.coalesce(F.col("before") == F.col("item_before"), F.lit(False)) | F.coalesce(F.col("after") == F.col("item_after"), F.lit(False))
    meets = mine.join(theirs, ["n", "hash"]).filter(agree).select("row_key", "item", (F.col("pos") - F.col("item_pos")).alias("shift"))

    meets = common.stored(meets.distinct(), "meets")
    # Only the texts that meet an item are split again.
    texts = docs.join(meets.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["row_key"]).select("row_key", words)
    return _extended(meets.join(texts, "row_key").join(items, "item"))


def _extended(pairs: DataFrame) -> DataFrame:
    """Runs of equal words on each diagonal that holds a fingerprint, at least a window long."""
    n = F.size("item_words")
    need = F.least(F.lit(WINDOW), n)
    # Item positions that have a document word on this diagonal.
    lo = F.greatest(F.lit(0), -F.col("shift"))
    hi = F.least(n, F.size("words") - F.col("shift"))
    same = F.when(
        hi > lo,
        F.zip_with(F.slice("item_words", lo + 1, hi - lo), F.slice("words", F.col("shift") + lo + 1, hi - lo), lambda a, b: a == b),
    ).otherwise(F.array().cast("array<boolean>"))
    pairs = pairs.withColumn("same", same).withColumn("lo", F.col("shift") + lo)
    # Ends of runs: positions of unequal words, with one before and one after all.
    gaps = F.filter(F.transform("same", lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
    pairs = pairs.withColumn("gaps", F.concat(F.array(F.lit(-1)), gaps, F.array(F.size("same"))))
    runs = F.filter(
        F.zip_with(F.slice("gaps", 1, F.size("gaps") - 1), F.slice("gaps", 2, F.size("gaps") - 1), lambda a, b: F.struct((a + 1).alias("a"), b.alias("b"))),
        lambda r: r["b"] - r["a"] >= need,
    )
    hits = pairs.select("row_key", "item", F.transform(runs, lambda r: F.struct((r["a"] + F.col("lo")).alias("first"), (r["b"] + F.col("lo")).alias("last"))).alias("spans")).filter(F.size("spans") > 0)
    spans = hits.select("row_key", F.explode("spans").alias("span")).groupBy("row_key").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    items = hits.select("row_key", F.col("item").cast("string").alias("item")).groupBy("row_key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    return spans.select("row_key", merged(F.col("spans")).alias("spans")).join(items, "row_key")


def merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap joined."""
    kind = "array<struct<first:int,last:int>>"

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (s["first"] <= F.try_element_at(done, F.lit(-1))["last"])
        grown = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), add)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with n_words, spans, item_ids, n_hit and contaminated."""
    names = ["n_words", "spans", "item_ids", "n_hit", "contaminated"]
    key = F.xxhash64("doc_id", "text")
    hits = contamination(docs.select(key.alias("row_key"), "text"), items)
    # Words are counted before the join, so that it need not move texts that its caller does not ask for.
    out = docs.drop(*names).withColumns({"_row": key, "n_words": n_words(F.col("text"))})
    out = out.join(hits.withColumnRenamed("row_key", "_key"), F.col("_row") == F.col("_key"), "left").drop("_row", "_key")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return out.withColumns({
        "n_hit": F.coalesce(n_hit, F.lit(0)).cast("long"),
        "contaminated": F.col("spans").isNotNull(),
    })


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminated(docs, common.table(spark, sf_dir, "benchmark"))
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated",
    )
