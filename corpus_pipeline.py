"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and reads it back as the next stage's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioloom.llm import exact_dedup, langid, mixing, packing, similar
from folioloom.session import release, scratch, staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; others go."""
    return langid.accept_documents(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(spark, docs, files=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more, exactly verified."""
    return similar.drop_similar_documents(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix emits them."""
    return mixing.mix(spark, docs, files=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, one row a piece."""
    return packing.pack(spark, docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixed), ("pack", packed)]

#: Trigram models, SimHash components and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's own files, and what it read of the stage before, go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            kept = keep(staged(spark, stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if at:
            release(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
