"""Corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes every stage's result to a Parquet table in the shared folder and reads it
back as the next stage's documents; the table before it is removed then.  All but
the last return the columns of ``documents``, whatever further columns these have.

Cases of all stages: an empty table gives an empty table; rows are never tied to
their place in a file; equal rows are rows of their own.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollscope.llm import op1_jaccard, op6_mixing, op8_packing, op9_quality, op10_secrets
from rollscope.llm.common import cut, documents, drop, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null, empty and word-less texts fail the base rules.  Null languages and sources are
    groups like others.  Equal rows get the same verdict; long texts are read whole."""
    small_batches(spark)
    return op9_quality.filtered(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each component of linked documents.

    Texts without words are linked with nothing and stay.  Rows of a kept doc_id with the
    same shingles are one document, with other shingles documents of their own; a null
    doc_id is linked with nothing."""
    small_batches(spark)
    return op1_jaccard.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` in place of every span found.

    A null text stays null, and texts without findings stay as they are; overlapping spans
    are taken out together; n_chars follows the text where there is such a column."""
    return op10_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its own draw say.

    The null source is a source like others; documents of a source without words go.  Rows
    that repeat a doc_id draw the same number."""
    return op6_mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences.

    A null or empty text is its end id alone.  Copies that the mix makes of a document are
    packed one by one; a long text is cut into full windows and a rest."""
    small_batches(spark)
    return op8_packing.pack(docs)


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: The stages on fitted covariances and token ids have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
