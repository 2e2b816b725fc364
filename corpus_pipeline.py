"""Training-corpus pipeline over `documents`: five stages, each written as Parquet and read again as the next one's docs.

Toxic documents go; of each group of near-duplicates the document of least id stays; documents that hold a benchmark
passage go; personal data is masked in the text; the rest is encoded. All stages but the last return the columns of
their input. Null texts pass every filter and come out with null ids; see the operators for other odd cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import decontaminate, pii, sentencepiece_scan, simhash, toxicity
from ravelin.runtime import discard, materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", encoding_stage),
]

#: No SQL: compression, SimHash components and BPE can't be expressed in it. tests/llm checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; the table of each stage is deleted once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*last)
        last = [docs]
    return docs
