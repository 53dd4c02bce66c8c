"""Comparing and combining tables: key overlap, seen keys, stacking, run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_overlap(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct keys in ``a``, in ``b``, in both, and the percent of ``b`` seen in ``a``, per column.

    All columns go through one shuffle; rows of a hot key are folded together before it. A missing
    key counts as one key.
    """

    def long(df: DataFrame, side: str) -> DataFrame:
        texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        return texts.unpivot([], list(columns), "entity", "key").withColumn("side", F.lit(side))

    both = long(a, "a").unionByName(long(b, "b"))
    per_key = both.groupBy("entity", "key").agg(
        F.max((F.col("side") == "a").cast("int")).alias("in_a"),
        F.max((F.col("side") == "b").cast("int")).alias("in_b"),
    )
    shared = F.sum(F.col("in_a") * F.col("in_b"))
    return per_key.groupBy("entity").agg(
        F.sum("in_a").cast("bigint").alias("n_unique_a"),
        F.sum("in_b").cast("bigint").alias("n_unique_b"),
        shared.cast("bigint").alias("n_overlap"),
        F.round(shared / F.greatest(F.sum("in_b"), F.lit(1)) * 100, 2).alias("pct_of_b_seen_in_a"),
    )


def mark_seen(rows: DataFrame, known: DataFrame, key: str, name: str = "seen") -> DataFrame:
    """Flag the rows whose key occurs in ``known``.

    The key list is made distinct first. Its size is not known beforehand, so the join strategy and
    the splitting of a hot key are left to adaptive execution.
    """
    keys = known.where(F.col(key).isNotNull()).select(F.col(key).alias("_known")).distinct()
    joined = rows.join(keys, F.col(key) == F.col("_known"), "left")
    return joined.withColumn(name, F.col("_known").isNotNull()).drop("_known")


def seen_rows(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_semi")


def unseen_rows(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def stack_with_flag(train: DataFrame, test: DataFrame, name: str = "is_test") -> DataFrame:
    return train.withColumn(name, F.lit(0)).unionByName(test.withColumn(name, F.lit(1)))


def compare_runs(base: DataFrame, improved: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics of two runs side by side with their difference; only keys present in both."""
    left = base.select(*keys, *[F.col(m).alias(f"{m}_base") for m in metrics])
    right = improved.select(*keys, *[F.col(m).alias(f"{m}_imp") for m in metrics])
    deltas = {f"{m}_delta": F.col(f"{m}_imp") - F.col(f"{m}_base") for m in metrics}
    return left.join(right, list(keys)).withColumns(deltas)
