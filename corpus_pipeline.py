"""A training-data pipeline over `documents`: quality, toxicity, near-duplicates, benchmark passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the
shared folder and reads again as the next stage's docs. All stages but the last return the columns of `documents`. A stage learns from
the labels of what its predecessor kept. Rows are judged where they are or told apart by id and text, never by id alone; a null doc_id has no
label, and its row keeps or loses its place by its own text. All columns of documents, whatever their names, come through up to the last
stage; texts are read whole; equal rows count as copies, of which one stays; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from versemill.llm import decontaminate, neardup, packing, quality, toxicity
from versemill.session import materialize, scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    return toxicity.filter_toxicity(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: candidates by SimHash and minhash bands, links by five-word shingles."""
    return neardup.near_dedup(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that hold benchmark windows."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, length=2048)


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("near_dedup", keep_one_of_each),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: No stage but the filters by exact words can be told in SQL: classifiers, fingerprints and tokenizers are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go once its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
