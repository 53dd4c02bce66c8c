"""Point-in-time history of an entity: what was known about a key just before each row.

Two notions of "before" are kept apart:

* position: every earlier row in (timestamp, id) order, so tied timestamps see each other in id order;
* time: only rows with a strictly smaller timestamp.

Ordinary keys are served by window frames, with one exchange per entity. When some key has more rows
than a task should sort, the same numbers come from an event form of the data: a row *arrives*,
*leaves* each rolling window, and its label *becomes known* after the lag. Every statistic is then a
running sum over earlier events, which can be cut anywhere: heavy keys are cut into pieces of a bounded
number of events, even inside a run of equal times, and the totals of the earlier pieces are added back.
No row is dropped and no key is capped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators import skew
from ledgerlark.operators.gate import refuse_unfit
from ledgerlark.operators.history_events import piecewise_statistics
from ledgerlark.operators.history_spec import DAY_US, Entity, LabelRate, Roles

_UNBOUNDED = Window.unboundedPreceding


def label_free_entities(device: str, receiver: str, subnet: str, account: str, sender: str) -> tuple[Entity, ...]:
    """The standard label-free feature set (29 columns)."""
    return (
        Entity("device", device, True, (1, 7, 30), (("accounts", account), ("receivers", receiver)), True, True, True),
        Entity("receiver", receiver, True, (7, 30), (("senders", sender), ("devices", device)), True, True, True),
        Entity("subnet", subnet, True, (7,), (("devices", device),)),
        Entity("account", account, True, age=True, first_flag=True),
    )


def with_label_rates(entities: Sequence[Entity], rates: Sequence[LabelRate] = (LabelRate(),),
                     names: Sequence[str] = ("device", "receiver")) -> tuple[Entity, ...]:
    """Add label rates to the named entities."""
    return tuple(replace(e, rates=tuple(rates)) if e.name in names else e for e in entities)


TRANSACTION_ENTITIES = label_free_entities("DeviceId", "ReceiverName", "IP_Subnet", "AccountNumber", "SenderName")


def label_prior(df: DataFrame, label: str, split: str | None = None) -> float:
    """Mean label of the rows of ``split`` (all rows when None)."""
    scope = df if split is None else df.where(F.col("split") == split)
    return float(scope.agg(F.avg(label)).first()[0])


def add_history(
    df: DataFrame,
    entities: Sequence[Entity],
    roles: Roles = Roles(),
    prior: float | None = None,
    hot_rows: int | None = skew.HOT_ROWS,
    block_rows: int = skew.BLOCK_ROWS,
    gated: bool = False,
) -> DataFrame:
    """Add the history columns of every entity to each row.

    Times, ids and (with label rates) labels must not be null, and ids must be unique: they order ties
    and, with several entities, bring their columns together. One pass checks this at every size and
    raises with the counts; ``gated`` says that ``gate.set_aside`` has been applied. Each entity then
    moves only the few columns it reads, and the full rows are moved once; a single entity works on the
    full rows directly. Keys with ``hot_rows`` rows or more are cut into pieces of ``block_rows`` events.
    """
    n = df.count() if gated else refuse_unfit(df, roles, any(e.rates for e in entities))
    if prior is None and any(e.rates for e in entities):
        prior = label_prior(df, roles.label)
    base = df.withColumn("_us", F.unix_micros(F.col(roles.ts).cast("timestamp")))
    if hot_rows is not None and n < hot_rows:
        hot_rows = None
    hot = skew.hot_keys_of(df, [e.key for e in entities], hot_rows)
    if len(entities) == 1 and hot[entities[0].key] is None:
        return finish(window_statistics(base, entities[0], roles), entities[0], roles, prior).drop("_us")
    out = df
    for e in entities:
        needed = dict.fromkeys([roles.id, "_us", e.key, *[t for _, t in e.distinct]])
        if e.amounts:
            needed[roles.amount] = None
        if e.rates:
            needed[roles.label] = None
        narrow = base.select(*needed)
        features = finish(_statistics(narrow, e, roles, hot[e.key], block_rows), e, roles, prior)
        out = out.join(features.select(roles.id, *[c for c in features.columns if c not in needed]), roles.id)
    new = [c for c in out.columns if c not in df.columns]
    return out.select(*df.columns, *new)


def _statistics(narrow: DataFrame, e: Entity, roles: Roles, hot: DataFrame | None, block_rows: int) -> DataFrame:
    """Raw statistics: window frames for ordinary keys, the event form for the rows of heavy keys."""
    if hot is None:
        return window_statistics(narrow, e, roles)
    marked = skew.mark_hot(narrow, e.key, hot)
    cold = window_statistics(marked.where(~F.col("_hot")).drop("_hot"), e, roles).drop("_h_slice")
    heavy = piecewise_statistics(marked.where("_hot").drop("_hot"), e, roles, block_rows)
    return cold.unionByName(heavy, allowMissingColumns=True)


def finish(raw: DataFrame, e: Entity, roles: Roles, prior: float | None) -> DataFrame:
    """Turn the raw counts and moments into output columns, with the defaults for unseen or null keys."""
    has_key = F.col(e.key).isNotNull()
    n = F.coalesce(F.col("_h_n"), F.lit(0))
    cols: dict[str, Column] = {}

    def counted(c: Column) -> Column:
        return F.when(has_key, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint")

    if e.count:
        cols["tx_count_all"] = counted(n)
    for w in e.windows:
        cols[f"tx_count_{w}d"] = counted(F.col("_h_strict") - F.col(f"_h_out_{w}"))
    for suffix, _ in e.distinct:
        cols[f"distinct_{suffix}_all"] = counted(F.col(f"_h_distinct_{suffix}"))
    if e.age:
        whole_seconds = F.floor((F.col("_us") - F.col("_h_first")) / F.lit(1_000_000))
        cols["first_seen_days_ago"] = F.when(has_key, whole_seconds / F.lit(86400.0)).otherwise(F.lit(0.0))
    if e.first_flag:
        cols["is_first_seen"] = (~has_key | (n == 0)).cast("int")
    if e.gap:
        cols["seconds_since_prev"] = F.when(has_key, (F.col("_us") - F.col("_h_last")) / F.lit(1_000_000.0))
    if e.amounts:
        def stat(c: str) -> Column:
            return F.when(has_key, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0))

        mean = stat("_h_mean")
        cols["amount_mean_prev"] = mean
        cols["amount_std_prev"] = stat("_h_std")
        cols["amount_max_prev"] = stat("_h_max")
        cols["amount_ratio_to_mean"] = F.when(mean > 0, F.col(roles.amount) / mean).otherwise(F.lit(1.0))
    for i, r in enumerate(e.rates):
        seen, hits = counted(F.col(f"_h_known_{i}")), counted(F.col(f"_h_hits_{i}"))
        p = F.lit(float(prior))
        cols[f"fraud_rate_smoothed{r.suffix}"] = (hits + F.lit(r.strength) * p) / (seen + F.lit(r.strength))
        cols[f"label_n{r.suffix}"] = seen
    kept = [c for c in raw.columns if not c.startswith("_h_")]
    return raw.select(*kept, *[c.alias(f"{e.name}_{name}") for name, c in cols.items()])


# -- ordinary keys: window frames ------------------------------------------------------------------


def window_statistics(df: DataFrame, e: Entity, roles: Roles) -> DataFrame:
    key, us, row_id = F.col(e.key), F.col("_us"), F.col(roles.id)
    out = df.withColumn("_h_slice", skew.slice_of(key, us, row_id, None))
    group = [e.key, "_h_slice"]
    if e.distinct:
        # one exchange on the key serves the (key, target) windows below as well
        out = out.repartition(*group)
    for suffix, target in e.distinct:
        firsts = Window.partitionBy(*group, target).orderBy("_us", roles.id)
        out = out.withColumn(f"_h_new_{suffix}", (F.row_number().over(firsts) == 1).cast("int"))

    by_position = Window.partitionBy(*group).orderBy("_us", roles.id)
    earlier = by_position.rowsBetween(_UNBOUNDED, -1)
    cols = {"_h_n": F.count(F.lit(1)).over(earlier)}
    for suffix, _ in e.distinct:
        cols[f"_h_distinct_{suffix}"] = F.sum(f"_h_new_{suffix}").over(earlier)
    if e.age:
        cols["_h_first"] = F.min("_us").over(by_position.rowsBetween(_UNBOUNDED, 0))
    if e.gap:
        cols["_h_last"] = F.max("_us").over(earlier)
    if e.amounts:
        cols["_h_mean"] = F.avg(roles.amount).over(earlier)
        cols["_h_std"] = F.stddev_pop(roles.amount).over(earlier)
        cols["_h_max"] = F.max(roles.amount).over(earlier)
    out = out.withColumns(cols)

    by_time = Window.partitionBy(*group).orderBy("_us")

    def until(last_us: int) -> Window:
        # frames that start at the beginning grow row by row; a sliding frame would be rescanned
        return by_time.rangeBetween(_UNBOUNDED, -last_us)

    cols = {}
    if e.windows:
        cols["_h_strict"] = F.count(F.lit(1)).over(until(1))
    for w in e.windows:
        cols[f"_h_out_{w}"] = F.count(F.lit(1)).over(until(w * DAY_US + 1))
    for i, r in enumerate(e.rates):
        known = until(r.lag_days * DAY_US + 1)
        n, k = F.count(F.lit(1)).over(known), F.sum(roles.label).over(known)
        if r.window_days is not None:
            gone = until((r.lag_days + r.window_days) * DAY_US + 1)
            n = n - F.count(F.lit(1)).over(gone)
            k = F.coalesce(k, F.lit(0)) - F.coalesce(F.sum(roles.label).over(gone), F.lit(0))
        cols[f"_h_known_{i}"], cols[f"_h_hits_{i}"] = n, k
    return out.withColumns(cols) if cols else out
