"""Corpus pipeline: language ID, near-dedup, benchmark decontamination, source mixing, token records.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents.  Its caller writes the result as Parquet before the next stage starts, so a stage begins by
deleting the working tables of the stage before it.

  language      drops documents in no learned language: null texts, texts without a letter and texts that no language describes
                better than spelling them out; a null lang becomes the predicted one
  near_dedup    keeps the document with the smallest doc_id of each group of near-duplicates
  decontaminate drops documents in which a window of a benchmark item occurs
  mix           thins to rates fitted within 0 to 1, as no document stands twice; scarce domains stay below their targets
  tokens        writes token records and returns their index

Defined results: without a single labelled row language keeps every text with a letter.  near_dedup judges texts: of several texts
with one doc_id each stays or goes by itself, and equal rows stay or go together; rows with a null doc_id, and empty
texts, have no duplicates and stay.  decontaminate and mix keep rows with null or empty texts, which have no words, and treat equal rows
alike; without benchmark items, or without usable labels, they keep all rows.  tokens gives a null or empty text its end id alone
and every row, repeated or not, a record.  Empty tables give empty results.  Columns beyond those of documents go
through the first four stages unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import common, decontam, langid, mixing, neardup, records

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.scope(spark, "pipeline"):
            return work(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = work.__name__, work.__doc__
    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(langid.LETTER))
    # The stage's own columns go by other names where the input has them too.
    own = {c: f"_own_{c}" for c in docs.columns if c.lower() in ("lang_pred", "score", "fits")}
    known = langid.identify(docs.withColumnsRenamed(own), model).filter("fits")
    lang = F.coalesce(F.col("lang"), F.col("lang_pred").cast(docs.schema["lang"].dataType))
    return known.withColumn("lang", lang).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, _key = F.xxhash64(F.col("doc_id").cast("long"), "text"), common.free_name(docs, "row_key")
    gone = common.stored(neardup.near_duplicates(docs.select("doc_id", "text")).filter(~F.col("kept")).select(F.col("row_key").alias(_key)).distinct(), "gone")
    return docs.withColumn(_key, key).join(gone, _key, "left_anti").select(*docs.columns)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, _key = F.xxhash64(F.col("doc_id").cast("long"), "text"), common.free_name(docs, "row_key")
    hits = decontam.contamination(docs.select(key.alias("row_key"), "text"), common.table(spark, sf_dir, "benchmark"))
    hits = common.stored(hits.select(F.col("row_key").alias(_key)), "contaminated")
    return docs.withColumn(_key, key).join(hits, _key, "left_anti").select(*docs.columns)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.kept_by_rate(docs, common.table(spark, sf_dir, "labels"))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return records.encode_records(docs).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Several stages train models or write files; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.new_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
