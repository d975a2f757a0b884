"""Corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseloom.llm import common, decontam, langid, nearcopies, packing, pii


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject."""
    return langid.language_stage(common.prepare(spark), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return nearcopies.near_copy_stage(common.prepare(spark), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, by the contract's rule."""
    return decontam.decontamination_stage(spark, docs, common.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data redacted."""
    return pii.pii_stage(common.prepare(spark), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.packing_stage(common.prepare(spark), docs)


STAGES = [
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Models and the Gray-order join have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    base = common.scratch(spark, "pipeline")
    last = ""
    for name, stage in STAGES[:-1]:
        since = common.scratch_count()
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        # What the stage needed goes, and its input with it.
        common.release(spark, since)
        if last:
            common.drop_path(spark, last)
        last = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
