"""The shortest way through the whole engine: history, score, alert budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import over, stable, stable_sql
from ledgerlark.catalog.metric_queries import _budget_sql
from ledgerlark.catalog.views import ROLES, tx_events
from ledgerlark.functions.rows import weighted_rules
from ledgerlark.operators.history import DAY_US, Entity, LabelRate, add_history, label_prior
from ledgerlark.operators.metrics import Budget, at_budgets

ENTITIES = (Entity("device", "device", True, (1, 7), rates=(LabelRate(7),)),)


def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall on the test rows for a 1 % alert budget."""
    tx = tx_events(spark, sf_dir)
    featured = add_history(tx, ENTITIES, ROLES, label_prior(tx, "label", "train")).where("split = 'test'")
    rules = [
        (F.col("device_fraud_rate_smoothed"), 2.0),
        (F.col("device_tx_count_1d") >= 5, 0.2),
        (F.col("amount") / 1000, 1.0),
    ]
    scored = featured.withColumn("score", stable(weighted_rules(rules)))
    out = at_budgets(scored, "label", "score", ("ts", "tx_id"), [Budget("percentile", 0.01)])
    return out.withColumns({c: stable(F.col(c)) for c in ("threshold", "precision", "recall", "fraud_capture_pct")})


_SCORE = f"""least(greatest(2.0 * (hits + 50.0 * prior) / (seen + 50.0) + 0.2 * (d1 >= 5)::int + amount / 1000, 0), 1)::double"""
BUDGET_SQL = over("tx_events", f"""
, h as (select *, count(*) over (partition by device order by us range between {DAY_US} preceding and 1 preceding) d1,
    count(*) over w seen, coalesce(sum(label) over w, 0) hits, (select avg(label) from tx where split = 'train') prior
  from (select *, epoch_us(ts) us from tx)
  window w as (partition by device order by us range between unbounded preceding and {7 * DAY_US + 1} preceding)),
s as (select *, {stable_sql(_SCORE)} as score from h where split = 'test')
""" + _budget_sql("('percentile', 0.01::double)"))

QUERIES = {"budget_report": budget_report}
ORACLES = {"budget_report": BUDGET_SQL}
