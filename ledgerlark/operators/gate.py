"""The gate before history: rows without a time, id or label, or with a repeated id, have no place in it.

A row without a time would count as earlier than everything and bring its label into its own rate; a
repeated id has no order among ties and multiplies rows when columns are joined by id. Such rows are set
aside with the reason, whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.history_spec import Roles

REASON = "rejected_because"


class UnfitRows(ValueError):
    """The table has rows that history cannot order."""


def set_aside(df: DataFrame, roles: Roles = Roles(), label: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows fit for history, the others with ``rejected_because``).

    Every row whose id occurs more than once is set aside: none of them can be told to be the true one.
    """
    reason = F.when(F.col(roles.ts).isNull(), "no_time").when(F.col(roles.id).isNull(), "no_id")
    if label:
        reason = reason.when(F.col(roles.label).isNull(), "no_label")
    counts = df.where(F.col(roles.id).isNotNull()).groupBy(F.col(roles.id).alias("_repeated")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.where("_n > 1").select("_repeated")
    marked = df.join(repeated, F.col(roles.id) == F.col("_repeated"), "left")
    marked = marked.withColumn(REASON, reason.when(F.col("_repeated").isNotNull(), "repeated_id")).drop("_repeated")
    return marked.where(F.col(REASON).isNull()).drop(REASON), marked.where(F.col(REASON).isNotNull())


def rejected_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy(REASON).agg(F.count(F.lit(1)).alias("n"))


def refuse_unfit(df: DataFrame, roles: Roles, label: bool) -> int:
    """Number of rows; raises ``UnfitRows`` with the counts if any row would have been set aside."""
    no_label = F.count_if(F.col(roles.label).isNull()) if label else F.lit(0)
    by_id = df.groupBy(F.col(roles.id).alias("_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(roles.ts).isNull()).alias("no_time"), no_label.cast("bigint").alias("no_label")
    )
    none = F.col("_id").isNull()
    found = by_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("no_time"), F.lit(0)).alias("no_time"), F.coalesce(F.sum("no_label"), F.lit(0)).alias("no_label"),
        F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)).alias("no_id"), F.coalesce(F.sum(F.when(~none & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated_id"),
    ).first().asDict()
    rows = int(found.pop("rows"))
    bad = {reason: int(n) for reason, n in found.items() if n}
    if bad:
        raise UnfitRows(f"set these rows aside before building history: {bad} of {rows}")
    return rows
