"""Point-in-time history queries and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import over, stable, stable_sql
from ledgerlark.catalog.views import ENTITIES, ORDER_ENTITIES, ROLES, tx_events, tx_orders
from ledgerlark.operators.gate import rejected_counts, set_aside
from ledgerlark.operators.history import DAY_US, Entity, LabelRate, add_history, label_prior, with_label_rates

# days are short here because the event view spans 30 days
COUNTS = (Entity("device", "device", windows=(1, 7, 30)), Entity("receiver", "receiver", windows=(7, 30)))
EXPANDING = (
    Entity("device", "device", True, first_flag=True),
    Entity("receiver", "receiver", True, first_flag=True),
    Entity("account", "account", True, first_flag=True),
)
DISTINCT = (
    Entity("device", "device", distinct=(("accounts", "account"), ("receivers", "receiver"), ("subnets", "subnet"))),
    Entity("receiver", "receiver", distinct=(("senders", "sender"), ("devices", "device"))),
)
AGE = (Entity("device", "device", age=True), Entity("account", "account", age=True))
AMOUNTS = (Entity("device", "device", amounts=True), Entity("receiver", "receiver", amounts=True))
RATE = (Entity("device", "device", rates=(LabelRate(7),)), Entity("receiver", "receiver", rates=(LabelRate(7),)))
LAGS = (Entity("device", "device", rates=tuple(LabelRate(d, suffix=f"_lag{d}") for d in (1, 3, 7, 14))),)
WINDOWED_RATE = (Entity("receiver", "receiver", rates=(LabelRate(2, window_days=7),)),)
GAP = (Entity("device", "device", gap=True), Entity("account", "account", gap=True))
TIES = (Entity("device", "device", True, (1, 7)), Entity("receiver", "receiver", True, (7,), (("devices", "device"),), True))
GATED = (
    Entity("device", "device", True, (1, 7), (("receivers", "receiver"),), True, True, True, rates=(LabelRate(7),)),
    Entity("receiver", "receiver", True, (7,), rates=(LabelRate(3),)),
)
TIED = (
    Entity("device", "device", True, (1, 7), (("receivers", "receiver"),), True, True, True, True, (LabelRate(3), LabelRate(1, window_days=5, suffix="_w5"))),
    Entity("receiver", "receiver", True, (7,), (("devices", "device"),), rates=(LabelRate(3),)),
)
PRIOR = 0.0732
# so many rows make a key heavy, and so many events fill a piece of it
SMALL_HOT, SMALL_PIECE = 50, 64

FLOATS = ("_first_seen_days_ago", "_prev", "_ratio_to_mean", "_seconds_since_prev")


def _outputs(df: DataFrame, names: Sequence[str], entities: Sequence[Entity], places: int) -> DataFrame:
    """Row id and history columns in comparable form."""
    prefixes = tuple(f"{e.name}_" for e in entities)
    cols = []
    for c in names:
        if not c.startswith(prefixes):
            continue
        if "fraud_rate" in c:
            cols.append(stable(F.col(c)).alias(c))
        elif c.endswith(FLOATS):
            cols.append(stable(F.col(c), places).alias(c))
        else:
            cols.append(F.col(c).cast("bigint").alias(c))
    return df.select("tx_id", *cols)


def _query(view: Callable, entities: Sequence[Entity], prior: float | str = PRIOR, places: int = 4, **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tx = view(spark, sf_dir)
        p = label_prior(tx, "label", prior) if isinstance(prior, str) else prior
        out = add_history(tx, entities, ROLES, p, **kw)
        return _outputs(out, [c for c in out.columns if c not in tx.columns], entities, places)

    return run


# the same rows with times that could not be read, and with ids that are missing or repeated
BAD_ROWS = {
    "times": {"ts": "case when tx_id % 7 <> 0 then ts end", "label": "case when tx_id % 31 <> 5 then label end"},
    "ids": {"tx_id": "case when tx_id % 11 = 0 then null when tx_id % 13 = 0 then tx_id - tx_id % 26 else tx_id end"},
}
REASON_SQL = """case when ts is null then 'no_time' when tx_id is null then 'no_id' when label is null then 'no_label'
    when tx_id in (select tx_id from bad group by tx_id having count(*) > 1) then 'repeated_id' end"""


def _with_bad_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return tx_events(spark, sf_dir).withColumns({c: F.expr(e) for c, e in BAD_ROWS[kind].items()})


# every time falls on a midnight, and one device has half of all rows: its ties span many pieces
ONE_DAY = {"ts": "date_trunc('day', ts)", "device": "case when tx_id % 2 = 0 then 1 else device end"}


def _one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx_events(spark, sf_dir).withColumns({c: F.expr(e) for c, e in ONE_DAY.items()})


def _gated(kind: str, entities: Sequence[Entity], **kw):
    """History of the rows that pass the gate."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        good, _ = set_aside(_with_bad_rows(spark, sf_dir, kind), ROLES)
        out = add_history(good, entities, ROLES, PRIOR, **kw)
        return _outputs(out, [c for c in out.columns if c not in good.columns], entities, 4)

    return run


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows set aside before history, counted by reason."""
    found = [rejected_counts(set_aside(_with_bad_rows(spark, sf_dir, k), ROLES)[1]).withColumn("kind", F.lit(k)) for k in BAD_ROWS]
    return found[0].unionByName(found[1])


def bad_rows_sql(kind: str) -> str:
    changed = ", ".join(f"{e} as {c}" for c, e in BAD_ROWS[kind].items())
    return f", bad as (select * replace ({changed}) from tx), reasoned as (select *, {REASON_SQL} as reason from bad)"


def _rejected_sql() -> str:
    parts = [
        over("tx_events", f"{bad_rows_sql(k)} select '{k}' as kind, reason as rejected_because, count(*)::bigint as n from reasoned where reason is not null group by 2")
        for k in BAD_ROWS
    ]
    return " union all ".join(f"select * from ({p})" for p in parts)


def history_sql(view: str, entities: Sequence[Entity], prior: float | str = PRIOR, places: int = 4, bad: str | None = None,
                changed: dict[str, str] | None = None) -> str:
    """The same columns from plain window frames, of the good rows only if some are made ``bad``."""
    cols = ["tx_id"]
    p = f"(select avg(label) from tx where split = '{prior}')" if isinstance(prior, str) else str(prior)

    def guard(e: Entity, expr: str, default: str = "0") -> str:
        return f"case when {e.key} is null then {default} else coalesce({expr}, {default}) end"

    for e in entities:
        pos = f"over (partition by {e.key} order by us, tx_id rows between unbounded preceding and 1 preceding)"

        def span(lo: int | None, hi: int) -> str:
            start = "unbounded" if lo is None else str(lo)
            return f"over (partition by {e.key} order by us range between {start} preceding and {hi} preceding)"

        n = guard(e, f"count(*) {pos}")
        if e.count:
            cols.append(f"({n})::bigint as {e.name}_tx_count_all")
        for w in e.windows:
            cols.append(f"({guard(e, f'count(*) {span(w * DAY_US, 1)}')})::bigint as {e.name}_tx_count_{w}d")
        for s, t in e.distinct:
            # a missing target counts as one value
            expr = f"count(distinct coalesce({t}::varchar, 'none')) {pos}"
            cols.append(f"({guard(e, expr)})::bigint as {e.name}_distinct_{s}_all")
        if e.age:
            age = guard(e, f"floor((us - min(us) over (partition by {e.key})) / 1000000.0) / 86400.0")
            cols.append(f"{stable_sql(age, places)} as {e.name}_first_seen_days_ago")
        if e.first_flag:
            cols.append(f"case when ({n}) = 0 then 1 else 0 end::bigint as {e.name}_is_first_seen")
        if e.gap:
            lag = f"lag(us) over (partition by {e.key} order by us, tx_id)"
            cols.append(f"{stable_sql(f'(us - {lag}) / 1000000.0', places)} as {e.name}_seconds_since_prev")
        if e.amounts:
            stats = {"mean": "avg(amount)", "std": "stddev_pop(amount)", "max": "max(amount)"}
            for s, f in stats.items():
                cols.append(f"{stable_sql(guard(e, f'{f} {pos}', '0.0'), places)} as {e.name}_amount_{s}_prev")
            mean = guard(e, f"avg(amount) {pos}", "0.0")
            ratio = f"case when {mean} > 0 then amount / ({mean}) else 1.0 end"
            cols.append(f"{stable_sql(ratio, places)} as {e.name}_amount_ratio_to_mean")
        for r in e.rates:
            lag = r.lag_days * DAY_US
            frame = span(None if r.window_days is None else lag + r.window_days * DAY_US, lag + 1)
            seen, hits = guard(e, f"count(*) {frame}"), guard(e, f"sum(label) {frame}")
            rate = f"(({hits}) + {r.strength} * {p}) / (({seen}) + {r.strength})"
            cols.append(f"{stable_sql(rate)} as {e.name}_fraud_rate_smoothed{r.suffix}")
            cols.append(f"({seen})::bigint as {e.name}_label_n{r.suffix}")
    rows = "tx" if bad is None else "(select * from reasoned where reason is null)"
    before = "" if bad is None else bad_rows_sql(bad) + "\n"
    if changed:
        rows = f"(select * replace ({', '.join(f'{e} as {c}' for c, e in changed.items())}) from tx)"
    return over(view, before + "select " + ",\n  ".join(cols) + f"\nfrom (select *, epoch_us(ts) us from {rows}) t")


ALL = with_label_rates(ENTITIES)

QUERIES = {
    "pit_rolling_counts": _query(tx_events, COUNTS),
    "pit_expanding_counts": _query(tx_events, EXPANDING),
    "pit_distinct_counts": _query(tx_events, DISTINCT),
    "pit_first_seen": _query(tx_events, AGE),
    "pit_amount_stats": _query(tx_events, AMOUNTS),
    "pit_label_rate": _query(tx_events, RATE, "train"),
    "pit_label_rate_lags": _query(tx_events, LAGS),
    "pit_label_rate_windowed": _query(tx_events, WINDOWED_RATE),
    "time_since_prev": _query(tx_events, GAP),
    "pit_ties": _query(tx_orders, TIES),
    "pit_orders_null_keys": _query(tx_orders, with_label_rates(ORDER_ENTITIES), places=3),
    "features_label_free": _query(tx_events, ENTITIES),
    "features_all": _query(tx_events, ALL, "train"),
    # the same tables with every key of 50 rows or more treated as heavy
    "pit_heavy_keys": _query(tx_events, ALL, "train", hot_rows=SMALL_HOT, block_rows=SMALL_PIECE),
    "pit_heavy_keys_ties": _query(
        tx_orders, with_label_rates(ORDER_ENTITIES), places=3, hot_rows=SMALL_HOT, block_rows=SMALL_PIECE
    ),
    "pit_heavy_ties_one_day": _query(_one_day, TIED, hot_rows=SMALL_HOT, block_rows=SMALL_PIECE),
    # rows that history cannot order are set aside first, on both paths and for one entity and two
    "rejected_rows": rejected_rows,
    "pit_bad_times": _gated("times", GATED),
    "pit_bad_times_heavy": _gated("times", GATED, hot_rows=SMALL_HOT, block_rows=SMALL_PIECE),
    "pit_bad_times_one": _gated("times", GATED[:1]),
    "pit_bad_ids": _gated("ids", GATED),
    "pit_bad_ids_heavy": _gated("ids", GATED, hot_rows=SMALL_HOT, block_rows=SMALL_PIECE),
    "pit_bad_ids_one": _gated("ids", GATED[:1], hot_rows=SMALL_HOT, block_rows=SMALL_PIECE),
}

ORACLES = {
    "pit_rolling_counts": history_sql("tx_events", COUNTS),
    "pit_expanding_counts": history_sql("tx_events", EXPANDING),
    "pit_distinct_counts": history_sql("tx_events", DISTINCT),
    "pit_first_seen": history_sql("tx_events", AGE),
    "pit_amount_stats": history_sql("tx_events", AMOUNTS),
    "pit_label_rate": history_sql("tx_events", RATE, "train"),
    "pit_label_rate_lags": history_sql("tx_events", LAGS),
    "pit_label_rate_windowed": history_sql("tx_events", WINDOWED_RATE),
    "time_since_prev": history_sql("tx_events", GAP),
    "pit_ties": history_sql("tx_orders", TIES),
    "pit_orders_null_keys": history_sql("tx_orders", with_label_rates(ORDER_ENTITIES), places=3),
    "features_label_free": history_sql("tx_events", ENTITIES),
    "features_all": history_sql("tx_events", ALL, "train"),
    "pit_heavy_keys": history_sql("tx_events", ALL, "train"),
    "pit_heavy_keys_ties": history_sql("tx_orders", with_label_rates(ORDER_ENTITIES), places=3),
    "pit_heavy_ties_one_day": history_sql("tx_events", TIED, changed=ONE_DAY),
    "rejected_rows": _rejected_sql(),
    **{f"pit_bad_{k}{s}": history_sql("tx_events", GATED, bad=k) for k in BAD_ROWS for s in ("", "_heavy")},
    **{f"pit_bad_{k}_one": history_sql("tx_events", GATED[:1], bad=k) for k in BAD_ROWS},
}
