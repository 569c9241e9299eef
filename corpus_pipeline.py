"""The corpus pipeline: language ID, quality, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, whatever these are called; an empty table gives an
empty one in every stage, and very long texts are read whole. As a stage's output is written before the next stage is
called, that call deletes what the stage before has left in the shared folder.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.llm import exact_dedup, lang_id, near_dup, packing, quality
from lumenary.llm.common import discard, materialize, numbered, recorded, remainder, table, without

#: Below this calibrated score a document is rejected.
LEAST_QUALITY = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left = threading.local()


def _stage(f: Stage) -> Stage:
    """The stage, which first deletes the intermediate tables of the one that this thread called before it in the same application."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application, paths = getattr(_left, "by", ("", []))
        if application == spark.sparkContext.applicationId:
            discard(spark, paths)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _left.by = (spark.sparkContext.applicationId, paths)
        return out

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null ones too) and texts that no learned language explains. Rows are judged one by one:
    repeated rows share their fate, and ties between languages reject nothing."""
    said = lang_id.language(lang_id.learn(docs))(F.col("text").cast("string"))
    judged = docs.select(F.struct("*").alias("row"), said.alias("said"))
    return judged.where(~lang_id.rejected(F.col("said"))).select("row.*")


@_stage
def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose calibrated score is under LEAST_QUALITY. Null texts are scored as empty ones; repeated rows
    share their score, and one that is just LEAST_QUALITY, as all are without labels, stays. Only the statistics of rows that
    may be learned from are written; every text is scored as it is read, so no copy of the texts is kept."""
    model = quality.learn(quality.measured(docs.where(remainder("doc_id", quality.FOLDS) != 1)), table(spark, sf_dir, "labels"))
    return docs.where(quality.score_text(model)(F.col("text").cast("string")) >= LEAST_QUALITY)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal after lower-casing A-Z, the one with the largest doc_id stays; a null text is an
    empty one, null ids are the smallest, and of repeated rows one stays."""
    rows = numbered(docs, "copies")
    return without(rows, exact_dedup.resolve(rows, row="number").where("row <> keep_row").select("row"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (similarity 0.8 or more), one of each group stays, that with the smallest
    doc_id (null ids last; of repeated rows one). Texts without words are linked with nothing and stay."""
    rows = numbered(docs, "near-copies")
    return without(rows, near_dup.classify(rows, k=5, percent=80, row="number").where("row <> component_row").select("row"))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. A null or empty text is its end id alone; repeated rows and null
    ids are packed each for itself; of pieces of equal length any may come first."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifiers nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's output is written to the shared folder and read by the next, after which it goes."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with recorded() as paths:
            docs = materialize(out, f"stage-{name}")
        discard(spark, before)
        before = paths
    return docs
