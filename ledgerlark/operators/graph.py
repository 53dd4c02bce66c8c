"""Receiver-sender edges: degrees, two-step paths and shared neighbours without listing pairs of a hot group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row per connected pair with its number of rows."""
    known = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return known.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))


def node_features(df: DataFrame, left: str, right: str) -> DataFrame:
    """For each left node: degree, rows, mean and largest degree of its neighbours, and the number of
    two-step paths to other left nodes (the sum of neighbour degrees less one each).

    Shared neighbours are counted through the neighbours' degrees, so pairs are never listed.
    """
    links = edges(df, left, right)
    degree = links.groupBy(right).agg(F.count(F.lit(1)).alias("_deg"))
    joined = links.join(degree, right)
    return joined.groupBy(left).agg(
        F.count(F.lit(1)).alias("degree"),
        F.sum("n").alias("rows"),
        F.avg("_deg").alias("neighbour_degree_mean"),
        F.max("_deg").alias("neighbour_degree_max"),
        F.sum(F.col("_deg") - 1).alias("two_step_paths"),
    )


def shared_neighbours(df: DataFrame, left: str, right: str, lg_k: int = 12) -> DataFrame:
    """For each left node, how many other left nodes share at least one neighbour with it.

    Pairs are never listed: each right node keeps a sketch of its left nodes, and the sketches of a node's
    neighbours are merged. The count is exact (before rounding, off by n^2 / 2^27) up to 3/32 of ``2 ** lg_k``
    nodes; above that its relative standard error is 1.04 / sqrt(2 ** lg_k), 1.6 % by default. A sketch has at
    most about ``2 ** lg_k`` bytes, so an edge to a hub costs no more than that.
    """
    links = edges(df, left, right)
    sketches = links.groupBy(right).agg(F.hll_sketch_agg(F.col(left).cast("string"), F.lit(lg_k)).alias("_sketch"))
    merged = links.join(sketches, right).groupBy(left).agg(F.hll_union_agg("_sketch").alias("_sketch"))
    return merged.select(left, F.greatest(F.hll_sketch_estimate("_sketch") - 1, F.lit(0)).cast("bigint").alias("shared_neighbours"))
