"""Connected components by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.session import pin


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); the component is the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label of that label, so a chain
    halves per round. Labels meet neighbours by joins on ids, whose heavy keys adaptive execution can
    split, and minima are taken on both sides of the shuffle. Nothing but a count reaches the driver.
    """
    both = pin(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = pin(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component")))
    while True:
        heard = both.join(labels, both["a"] == labels["id"]).select(F.col("b").alias("id"), "component")
        nearest = labels.unionByName(heard).groupBy("id").agg(F.min("component").alias("component"))
        via = labels.select(F.col("id").alias("_via"), F.col("component").alias("_of_via"))
        jumped = nearest.join(via, nearest["component"] == via["_via"]).select("id", F.least("component", "_of_via").alias("component"))
        old = labels.select(F.col("id").alias("_id"), F.col("component").alias("_old"))
        after = pin(jumped.join(old, jumped["id"] == old["_id"]).select("id", "component", (F.col("component") != F.col("_old")).alias("_moved")))
        labels = after.select("id", "component")
        if after.where("_moved").isEmpty():
            return labels
