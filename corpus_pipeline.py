"""Cleaning, deduplication, mixing and tokenization of a corpus, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; `run` writes it
to the shared folder and reads it back for the next one.  All stages but the last
return the columns of ``documents``.  A stage begins by deleting the intermediate
tables of the stages before it, but for those that ``docs`` is still read from.

Nulls, repeats and empty tables: a null text counts as empty in every stage; rows with a
null id, and rows repeated with one id, are judged by their texts like others; each stage
returns no rows for an empty table.  Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brookline.llm import bpe, exact_dedup, mixing, near_texts, toxicity
from brookline.llm.common import clean, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores toxic; it learns from the table of labels."""
    clean(spark, but=docs)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    clean(spark, but=docs)
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a five-word Jaccard of 0.8 or more the document with the smallest id stays."""
    clean(spark, but=docs)
    return near_texts.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents from the sources by their weights, some of them twice."""
    clean(spark, but=docs)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row for each taken document."""
    clean(spark, but=docs)
    return bpe.round_trip_digests(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash", near), ("mix", mix), ("bpe", encode)]

#: Trained and vectorised stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
