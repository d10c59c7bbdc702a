"""Corpus pipeline over ``documents``: a list of stages, each one operator.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the
columns that they get. Between stages the rows are written as Parquet to
the shared folder and read back, so a lost executor costs one stage at most.

Rows: a null, empty or unreadable text is rejected by the first stage unless
its ``doc_id`` is null; a row without ``doc_id`` passes all stages as it is and
is packed. Rows that repeat a ``doc_id`` are judged as one document: they stay
or go together. Other columns, whatever their names, pass through until the
last stage. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import cut, table
from gridloom.llm.decontam import decontaminate
from gridloom.llm.langid import keep_identified
from gridloom.llm.neardup import near_dedup
from gridloom.llm.packing import pack_documents
from gridloom.llm.substring import substring_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut from the text."""
    return substring_dedup(docs, detail=False)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of ``benchmark`` go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left."""
    return pack_documents(docs)


STAGES = [
    ("language id", language),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("packing", packed),
]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage{k}")
    return docs
