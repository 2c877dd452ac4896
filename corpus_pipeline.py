"""The training-data pipeline: quality, exact dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from massweave.llm.common import discard, documents, materialize
from massweave.llm.exact_dedup import exact_dedup
from massweave.llm.mixing import mix
from massweave.llm.near_dedup import near_dedup
from massweave.llm.packing import pack_documents
from massweave.llm.quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    A null or empty text is scored like any other; a null or repeated ``doc_id`` keeps its rows; without labels
    every score is 0.5 and all rows stay; an empty table stays empty; other columns pass, whatever their names.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the smallest ``doc_id``, null last.

    A null text is an empty one, and all empty ones are a group; of rows with one ``doc_id`` and text the one stays
    whose columns hash lowest; an empty table stays empty; other columns pass, whatever their names.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at four or fewer bits: the smallest ``doc_id``, null last.

    Null, empty and blank texts have the fingerprint 0; ties go by the columns' hash; an empty table stays empty;
    other columns pass, whatever their names.
    """
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, in training order: repeated, left out, or (one of a source) cut.

    A null source is a source of its own; a text without words is left out; of rows with one ``doc_id`` the one whose
    columns hash lower comes first; an empty table stays empty; other columns pass, whatever their names.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences.

    A null or empty text is its end token; every row, repeated or without a ``doc_id``, is a document of its own; an
    empty table gives no pieces; other columns are left out.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL has no classifier, tokenizer or bin packing; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``; each stage's result is written and read back before the next, and deleted once that one is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
            discard(before)
    return docs
