"""From raw documents to packed sequences: each stage works on all that the one before kept.

Stages (each takes spark, docs, sf_dir; what it returns is written as Parquet and read again as the next one's docs): quality rules,
SimHash near-duplicates, benchmark decontamination, personal data, packing. All but the last return the columns of documents.

Defined results: null, blank and very short texts fail the quality rules; of repeated rows one stays; without labels only the base rules
hold; without benchmark items every document is clean; an empty table gives no rows; other columns are kept up to packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import decontaminate, packing, pii, quality_rules, simhash
from loomspan.llm.common import documents, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles at a similarity of 0.8 or more, not op3's three words and bits."""
    return simhash.keep_one(docs, width=5, most=24, alike=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and the terms that give it away, are replaced."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL: fingerprints, learned rules and tokenisation are beyond it. tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
