"""A corpus pipeline: five of the corpus operators in a row, each stage written and read again.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; a stage works on all that its predecessor kept. ``doc_id`` is the
key of documents. A stage's result is to be written before the next stage
begins: intermediate tables of earlier stages are deleted then.

Defined results of all stages: an empty table gives an empty one, texts of any
length are judged whole, and further columns travel with their rows. Rows that
repeat a doc_id and its text share its verdict. What null and empty texts and
rows without a doc_id come to is said with each stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, language_id, near_dedup, packing, suffix_dedup
from tilewright.llm.common import SPACE, Scratch, discard, documents, materialize

#: Intermediate tables of the stage that ran last.
_scratch = Scratch()


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scratch.release()
        with _scratch:
            return f(spark, docs, sf_dir)

    return run_stage

#: Language predictions below this score are rejected, as are texts without a letter.
LEAST_SCORE = 0.4


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null and empty ones among them, and those that fit no language, go. Rows without an id are judged alike."""
    columns = tuple(docs.columns)
    judged = language_id.predict(docs, language_id.fit(docs), keep=columns)
    # Without any labelled text there is no language to reject by.
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*columns)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id stays. Null and empty texts resemble nothing and stay; rows without an id cannot be ranked and stay."""
    known = docs.where("doc_id IS NOT NULL")
    gone = near_dedup.near_duplicates(known, shingle=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_stage
def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte strings of documents with smaller ids go; so do documents of which no word is left, null and empty ones among them. Rows without an id come after all others."""
    cut = suffix_dedup.dedup(docs, with_text=True, carry=[c for c in docs.columns if c != "text"])
    return cut.where(F.btrim("kept", F.lit(SPACE)) != "").select("row.*", F.col("kept").alias("text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null and empty texts hold none; rows without an id stay."""
    leaks = decontaminate.overlaps(docs.where("doc_id IS NOT NULL"), documents(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences. Null and empty texts are an end id alone; repeated rows and rows without an id are packed one by one."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_text", repeated_text), ("benchmark_leaks", benchmark_leaks), ("packing", pack)]

#: A trained model, byte-wise suffixes and a search for packings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            discard(written)
        written = docs
    _scratch.release()
    return docs
