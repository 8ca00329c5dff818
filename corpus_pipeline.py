"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the
last return the columns of ``documents``. Results are written as Parquet in the cluster's shared
folder and read again between stages, so a lost executor costs at most the running stage.

1. language ID: rows whose language is rejected go (compression classification; learned from the
   rows of the stage's input that are not held out).
2. exact dedup: of equal texts one row stays (tree merge of digest runs).
3. near duplicates: of each class of linked documents the one with the least id stays (chosen-path
   Jaccard join on five-word shingles, 0.8).
4. decontamination: documents that hold a benchmark window go (winnowing).
5. mixing: sources to target weights (Sainte-Lague); one row per document with the words taken.

Edge cases are those of the operators: an empty table passes every stage, null texts are rejected
by the first, extra columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, exact_dedup, language, mixing, near_join
from quire.llm.common import table
from quire.session import checkpoint_root


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit(language.learned_from(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
]

# Compression and chosen paths have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4()}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
