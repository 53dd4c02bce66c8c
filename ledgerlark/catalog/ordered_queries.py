"""Queries of the ordered target statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import over, stable, stable_sql
from ledgerlark.catalog.views import tx_orders
from ledgerlark.operators import target_statistics as O

COLUMNS, ORDERS, RATE, WEIGHT = ("segment", "os", "device"), (0, 7), 0.05, 2.0


def ordered_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows under two orders, cut into small pieces; later rows by all training rows."""
    tx = tx_orders(spark, sf_dir).select("tx_id", "split", "label", *COLUMNS)
    train, later = tx.where("split = 'train'"), tx.where("split <> 'train'")
    own = O.ordered_statistics(train, COLUMNS, "label", "tx_id", RATE, ORDERS, WEIGHT, block_rows=64)
    rest = O.settled_statistics(later, COLUMNS, O.category_sums(train, COLUMNS, "label"), RATE, ORDERS, WEIGHT)
    names = O.statistic_names(COLUMNS, ORDERS)
    return own.unionByName(rest.select("tx_id", *names)).select("tx_id", *[stable(F.col(c)).alias(c) for c in names])


def _sql() -> str:
    def rate(hits: str, seen: str) -> str:
        return stable_sql(f"(coalesce({hits}, 0) + {RATE * WEIGHT}) / (coalesce({seen}, 0) + {WEIGHT})")

    own, rest = [], []
    for c in COLUMNS:
        for s in ORDERS:
            frame = f"over (partition by {c} order by md5('{s}:' || tx_id), tx_id rows between unbounded preceding and 1 preceding)"
            own.append(f"{rate(f'sum(label) {frame}', f'count(*) {frame}')} as {c}__o{s}")
            rest.append(f"{rate(f's_{c}.k', f's_{c}.n')} as {c}__o{s}")
    sums = " ".join(f"left join (select {c}, count(*) n, sum(label) k from tx where split = 'train' group by 1) s_{c} on s_{c}.{c} is not distinct from tx.{c}" for c in COLUMNS)
    return over("tx_orders", f"select tx_id, {', '.join(own)} from tx where split = 'train' union all select tx_id, {', '.join(rest)} from tx {sums} where split <> 'train'")


QUERIES = {"ordered_statistics": ordered_statistics}
ORACLES = {"ordered_statistics": _sql()}
