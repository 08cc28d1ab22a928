"""A training corpus from ``documents``: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

Defined results: null texts count as empty in every stage and stay null until they are packed; rows with a null doc_id
are judged for quality, are copies of nothing, lose no repeats, and are mixed and packed like others; of rows with one
doc_id the near-duplicate stage keeps one; texts are used whole, however long; extra columns keep their names and values
up to packing, which gives its own columns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import table, written
from skerry.llm.mixing import mixed_documents
from skerry.llm.near_copies import keep_one
from skerry.llm.packing import packed_documents
from skerry.llm.quality import keep_quality
from skerry.llm.repeats import without_repeats

#: Words of a shingle in the near-duplicate stage, and the least Jaccard similarity of near-duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id: candidates by linked SimHash
    fingerprints and minima, each judged by the Jaccard similarity of whole sets of shingles."""
    return keep_one(docs, SHINGLE_WORDS, SIMILARITY)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes and more that an earlier document holds go from the texts."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights; a row for each epoch of a document."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 4096 and their places in packed sequences."""
    return packed_documents(docs)


STAGES = [("quality classifier", quality), ("SimHash and minima near-dedup", near_dedup), ("suffix-array dedup", repeats), ("source mixing", mixing), ("best-fit packing", packing)]

#: SQL can express neither the model nor the fingerprints; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
