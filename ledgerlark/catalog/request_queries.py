"""Requests scored from stored history totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import over, stable, stable_sql
from ledgerlark.catalog.history_queries import PRIOR, _outputs
from ledgerlark.catalog.views import ROLES, tx_events
from ledgerlark.functions.rows import add_bands
from ledgerlark.operators.history import DAY_US, Entity, LabelRate
from ledgerlark.plans.requests import history_totals, request_history
from ledgerlark.session import scratch_folder

ENTITIES = (
    Entity("device", "device", True, (1, 7), (("receivers", "receiver"),), True, True, True, rates=(LabelRate(7), LabelRate(2, 20.0, 5, "_w5"))),
    Entity("receiver", "receiver", True, (7,), rates=(LabelRate(3),)),
)
_DEVICE, CENTRE = "case when tx_id % 29 = 0 then null when tx_id % 31 = 0 then -5 else device end", 50.0


def request_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows as requests against the written totals of all earlier splits; some without a device, some with a new one."""
    tx = tx_events(spark, sf_dir)
    folder, totals = scratch_folder(spark, "totals"), {}
    for e in ENTITIES:
        history_totals(tx.where("split <> 'test'"), e, ROLES, CENTRE, block_rows=64).write.parquet(f"{folder}/{e.name}")
        totals[e.name] = spark.read.parquet(f"{folder}/{e.name}")
    asks = tx.where("split = 'test'").withColumn("device", F.expr(_DEVICE))
    out = request_history(asks, totals, ENTITIES, PRIOR, ROLES, CENTRE, hot_rows=50, block_rows=64)
    shown = _outputs(out, [c for c in out.columns if c not in asks.columns], ENTITIES, 4)
    return add_bands(shown, "device_fraud_rate_smoothed", {"HIGH": 0.075, "MEDIUM": 0.07}).select(*shown.columns, "risk_band")


def _sql() -> str:
    parts = []
    for e in ENTITIES:
        cols = ["r.tx_id", f"count(h.us)::bigint as {e.name}_tx_count_all"]
        cols += [f"(count(*) filter (h.us >= r.us - {w * DAY_US}))::bigint as {e.name}_tx_count_{w}d" for w in e.windows]
        cols += [f"count(distinct h.{t})::bigint as {e.name}_distinct_{s}_all" for s, t in e.distinct]
        if e.age:
            age = f"coalesce(floor((any_value(r.us) - min(h.us)) / 1000000.0) / 86400.0, 0)"
            cols.append(f"{stable_sql(age, 4)} as {e.name}_first_seen_days_ago")
        if e.first_flag:
            cols.append(f"(count(h.us) = 0)::bigint as {e.name}_is_first_seen")
        if e.amounts:
            for s, f in {"mean": "avg(h.amount)", "std": "stddev_pop(h.amount)", "max": "max(h.amount)"}.items():
                cols.append(f"{stable_sql(f'coalesce({f}, 0.0)', 4)} as {e.name}_amount_{s}_prev")
            cols.append(f"{stable_sql('case when avg(h.amount) > 0 then any_value(r.amount) / avg(h.amount) else 1.0 end', 4)} as {e.name}_amount_ratio_to_mean")
        for r in e.rates:
            lag = r.lag_days * DAY_US
            known = f"h.us < r.us - {lag}" + ("" if r.window_days is None else f" and h.us >= r.us - {lag + r.window_days * DAY_US}")
            n, k = f"count(*) filter ({known})", f"coalesce(sum(h.label) filter ({known}), 0)"
            cols.append(f"{stable_sql(f'({k} + {r.strength} * {PRIOR}) / ({n} + {r.strength})')} as {e.name}_fraud_rate_smoothed{r.suffix}")
            cols.append(f"({n})::bigint as {e.name}_label_n{r.suffix}")
        parts.append(f"{e.name} as (select {', '.join(cols)} from r left join h on h.{e.key} = r.{e.key} and h.us < r.us group by r.tx_id)")
    rate = "device_fraud_rate_smoothed"
    return over("tx_events", f"""
, h as (select *, epoch_us(ts) us from tx where split <> 'test'),
r as (select * replace ({_DEVICE} as device), epoch_us(ts) us from tx where split = 'test'),
{', '.join(parts)}
select *, case when {rate} >= 0.075 then 'HIGH' when {rate} >= 0.07 then 'MEDIUM' else 'LOW' end as risk_band from device join receiver using (tx_id)""")


QUERIES = {"request_features": request_features}
ORACLES = {"request_features": _sql()}
