"""From raw documents to packed training sequences: rules, classifier, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import stages
from ledgerlark.llm.tables import stored, table

STAGES = [
    ("quality_rules", stages.keep_by_rules),
    ("quality_classifier", stages.keep_by_score),
    ("minhash_near_dedup", stages.keep_one_of_each_group),
    ("benchmark_decontamination", stages.drop_benchmark_passages),
    ("best_fit_packing", stages.pack),
]

# learned models, components and packing have no SQL text; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
