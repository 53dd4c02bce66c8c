"""Operators as stages of a document pipeline: each takes documents and returns those it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import classifier, decontamination, minhash, packing, rules
from ledgerlark.llm.tables import table, text_key


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows whose id and text have a row in ``verdicts`` (doc_id, text_key); null counts as an id of its own."""
    keys = verdicts.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key")).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(keys["_kept_id"]) & (text_key(docs["text"]) == keys["_kept_key"])
    return docs.join(keys, same, "left_semi")


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and no learned rule rejects."""
    verdicts, _ = rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, verdicts.where("kept"))


def keep_by_score(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    return _kept(docs, classifier.quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once if its row repeats.

    A row repeats another if id and text are equal; which of such rows stays is open. Rows without an id are
    linked with nothing, so of them only repeats go.
    """
    ids = minhash.near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    ids = ids.select(F.col("doc_id").alias("_kept_id"), "_rows")
    found = docs.join(ids, docs["doc_id"].cast("bigint").eqNullSafe(ids["_kept_id"])).drop("_kept_id")
    once, often = found.where("_rows = 1"), found.where("_rows > 1").dropDuplicates(["doc_id", "text"])
    return once.unionByName(often).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_passages(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in fixed-length sequences."""
    return packing.packed(docs)
