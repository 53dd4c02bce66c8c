"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.views import TX_EVENTS, TX_ORDERS, tx_events
from ledgerlark.functions.rows import RuleColumns, rule_score

RULES = RuleColumns("l1h", "l8h", "os", "is_fractional", "tx_type", "segment", "amount")
EFT = "signup"


def stable(c: Column, places: int = 6) -> Column:
    """Round for comparison between engines; the small shift keeps exact halves on one side."""
    return F.round(c + F.lit(float(f"1e-{places + 4}")), places)


def stable_sql(expr: str, places: int = 6) -> str:
    return f"round(({expr}) + 1e-{places + 4}, {places})"


def over(view: str, body: str) -> str:
    """A query text over one of the two views, named tx."""
    text = {"tx_events": TX_EVENTS, "tx_orders": TX_ORDERS}[view]
    return f"with tx as ({text})\n{body}"


def scored_events(spark: SparkSession, sf_dir: str, places: int = 6) -> DataFrame:
    """The event view with the rule score, rounded so that both engines see equal scores."""
    return tx_events(spark, sf_dir).withColumn("score", stable(rule_score(RULES, eft=EFT), places))


RULE_SQL = f"""least(greatest(
    0.4 * (l1h = 1)::int + 0.2 * (l8h = 1)::int + 0.15 * (os = 'Android')::int + 0.1 * is_fractional::int
    + 0.1 * (tx_type = '{EFT}')::int + 0.05 * (segment in ('P','Y','KP','A1'))::int
    + 0.05 * least(ln(1 + greatest(amount, 0)) / 12, 1), 0), 1)::double"""


def scored_sql(body: str, places: int = 6) -> str:
    """A query text over the scored event view, named s."""
    return over("tx_events", f", s as (select *, {stable_sql(RULE_SQL, places)} as score from tx)\n{body}")
