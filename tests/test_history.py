import math

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerlark.catalog.views import ENTITIES, ORDER_ENTITIES, ROLES, tx_events, tx_orders
from ledgerlark.operators.history import DAY_US, Entity, LabelRate, add_history, with_label_rates
from ledgerlark.operators.history_events import piecewise_statistics

RATES = (LabelRate(7), LabelRate(2, 10.0, 5, "_w5"))


def brute_force(rows, entities, prior):
    """Every statistic straight from its definition."""
    rows = sorted(rows, key=lambda r: (r["us"], r["tx_id"]))
    out = {}
    for i, r in enumerate(rows):
        res = {}
        for e in entities:
            key, us = r[e.key], r["us"]
            same = [x for x in rows if key is not None and x[e.key] == key]
            pos = [x for x in rows[:i] if key is not None and x[e.key] == key]
            res[f"{e.name}_tx_count_all"] = len(pos)
            for w in e.windows:
                res[f"{e.name}_tx_count_{w}d"] = sum(us - w * DAY_US <= x["us"] < us for x in same)
            for s, t in e.distinct:
                res[f"{e.name}_distinct_{s}_all"] = len({x[t] for x in pos})
            if e.age:
                first = min([x["us"] for x in same], default=us)
                res[f"{e.name}_first_seen_days_ago"] = (us - first) // 1_000_000 / 86400.0
            if e.first_flag:
                res[f"{e.name}_is_first_seen"] = int(not pos)
            if e.gap:
                res[f"{e.name}_seconds_since_prev"] = (us - pos[-1]["us"]) / 1e6 if pos else None
            if e.amounts:
                a = [x["amount"] for x in pos]
                mean = sum(a) / len(a) if a else 0.0
                res[f"{e.name}_amount_mean_prev"] = mean
                res[f"{e.name}_amount_std_prev"] = math.sqrt(sum((v - mean) ** 2 for v in a) / len(a)) if a else 0.0
                res[f"{e.name}_amount_max_prev"] = max(a, default=0.0)
                res[f"{e.name}_amount_ratio_to_mean"] = r["amount"] / mean if mean > 0 else 1.0
            for q in e.rates:
                hi = us - q.lag_days * DAY_US
                lo = -math.inf if q.window_days is None else hi - q.window_days * DAY_US
                known = [x for x in same if lo <= x["us"] < hi]
                k = sum(x["label"] for x in known)
                res[f"{e.name}_fraud_rate_smoothed{q.suffix}"] = (k + q.strength * prior) / (len(known) + q.strength)
                res[f"{e.name}_label_n{q.suffix}"] = len(known)
        out[r["tx_id"]] = res
    return out


def check(spark, df, entities, **kw):
    df = df.cache()
    prior = 0.07
    rows = [r.asDict() for r in df.withColumn("us", F.unix_micros("ts")).collect()]
    want = brute_force(rows, entities, prior)
    got = {r["tx_id"]: r.asDict() for r in add_history(df, entities, ROLES, prior=prior, **kw).collect()}
    assert got.keys() == want.keys()
    for tx, res in want.items():
        for name, v in res.items():
            if v is None:
                assert got[tx][name] is None, (tx, name)
            else:
                assert got[tx][name] == pytest.approx(v, rel=1e-9, abs=1e-6), (tx, name)
    df.unpersist()


def gapped(entities):
    from dataclasses import replace

    return tuple(replace(e, gap=True) for e in entities)


@pytest.mark.parametrize("hot_rows", [None, 1, 30])
def test_events_match_definition(spark, hot_rows):
    entities = gapped(with_label_rates(ENTITIES, RATES))
    df = tx_events(spark, SMALL).where("tx_id % 2 = 0")
    check(spark, df, entities, hot_rows=hot_rows, block_rows=13)


@pytest.mark.parametrize("hot_rows", [None, 1, 20])
def test_ties_and_null_keys_match_definition(spark, hot_rows):
    entities = gapped(with_label_rates(ORDER_ENTITIES, RATES))
    df = tx_orders(spark, SMALL).where("tx_id % 3 = 0").withColumn("device", F.col("device") % 7)
    df = df.withColumn("ts", F.timestamp_micros(F.lit(0) + (F.unix_micros("ts") % (40 * DAY_US))))
    check(spark, df, entities, hot_rows=hot_rows, block_rows=7)


@pytest.mark.parametrize("block_rows", [1, 3, 40])
def test_a_tie_run_may_be_cut_anywhere(spark, block_rows):
    """One key holds half of all rows, all of them on a few midnights."""
    df = spark.createDataFrame(
        [(i, 1 if i % 2 else i % 5, i % 7, 1.5 * (i % 11) + 1, int(i % 6 == 0), i // 45) for i in range(180)],
        "tx_id bigint, device int, receiver int, amount double, label int, day int",
    ).select("tx_id", "device", "receiver", "amount", "label", F.timestamp_seconds(F.col("day") * 86400 + 1_700_000_000).alias("ts"))
    entities = (Entity("device", "device", True, (1, 2), (("receivers", "receiver"),), True, True, True, True, (LabelRate(1), LabelRate(1, 5.0, 2, "_w2"))),)
    check(spark, df, entities, hot_rows=1, block_rows=block_rows)


def test_no_window_group_is_above_the_bound(spark):
    from ledgerlark.operators.history_events import pieces_of

    df = tx_events(spark, SMALL).withColumns({"device": F.lit(1), "_us": F.unix_micros(F.date_trunc("day", "ts"))})
    e = Entity("device", "device", True, (1, 7), (("receivers", "receiver"),), rates=(LabelRate(7),))
    pieces = pieces_of(df, e, ROLES, 50)
    sizes = [r["count"] for r in pieces.groupBy("_e_key", "_e_slice").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) > 4 * df.count() and len(sizes) < 2 * sum(sizes) / 50 + 16


def test_lagged_rate_golden_rows(spark):
    rows = [("a", "r", "2023-09-08"), ("b", "r", "2023-09-24"), ("c", "r", "2023-09-26")]
    df = spark.createDataFrame([(*r, 1.0, 1) for r in rows], "tx_id string, receiver string, d string, amount double, label int")
    df = df.withColumn("ts", F.to_timestamp("d"))
    for hot_rows in (None, 1):
        got = add_history(df, [Entity("receiver", "receiver", rates=(LabelRate(),))], ROLES, 0.006283, hot_rows)
        got = got.orderBy("tx_id").select("receiver_label_n", F.round("receiver_fraud_rate_smoothed", 6)).collect()
        assert [tuple(r) for r in got] == [(0, 0.006283), (1, 0.025768), (1, 0.025768)]


def test_edges_are_strict(spark):
    rows = [(1, 0), (2, 0), (3, 7 * DAY_US)]
    df = spark.createDataFrame(rows, "tx_id long, us long").select(
        "tx_id", F.timestamp_micros("us").alias("ts"), F.lit("k").alias("k"), F.lit(5.0).alias("amount"), F.lit(1).alias("label")
    )
    e = Entity("k", "k", True, (7,), age=True, amounts=True, rates=(LabelRate(7),))
    for hot_rows in (None, 1):
        got = add_history(df, [e], ROLES, 0.5, hot_rows).orderBy("tx_id").collect()
        assert [r.k_tx_count_7d for r in got] == [0, 0, 2]
        assert [r.k_tx_count_all for r in got] == [0, 1, 2]
        assert [r.k_label_n for r in got] == [0, 0, 0]
        assert [r.k_amount_ratio_to_mean for r in got] == [1.0, 1.0, 1.0]
        assert got[2].k_first_seen_days_ago == 7.0 and got[0].k_amount_std_prev == 0.0


def test_future_rows_do_not_change_the_past(spark):
    df = tx_events(spark, SMALL)
    entities = with_label_rates(ENTITIES)
    early = df.where("ts < timestamp '2024-01-15'")
    full = add_history(df, entities, ROLES, 0.07).where("ts < timestamp '2024-01-15'")
    part = add_history(early.orderBy(F.rand(3)), entities, ROLES, 0.07)
    names = [c for c in full.columns if any(c.startswith(p) for p in ("device_", "receiver_", "subnet_", "account_"))]
    rounded = [F.round(F.col(c).cast("double"), 6).alias(c) for c in names]
    a, b = full.select("tx_id", *rounded), part.select("tx_id", *rounded)
    assert len(names) == 33
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_entity_is_shuffled_once(spark):
    """One exchange on each entity key; full rows move only for the join on the id."""
    tx = tx_events(spark, SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entities = with_label_rates(ENTITIES)
        text = _plan(add_history(tx, entities, ROLES, 0.07))
        by_id = text.count("Exchange hashpartitioning(tx_id")
        assert text.count("Exchange hashpartitioning") - by_id == len(entities)
        assert by_id == len(entities) + 1
        assert _plan(add_history(tx, entities[:1], ROLES, 0.07)).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_that_cannot_be_ordered_are_refused_or_set_aside(spark):
    from ledgerlark.operators.gate import UnfitRows, rejected_counts, set_aside

    rows = [(1, "2024-01-01 00:00:00", "k", 1), (2, None, "k", 1), (None, "2024-01-02 00:00:00", "k", 1), (3, "2024-01-03 00:00:00", "k", None),
            (4, "2024-01-04 00:00:00", "k", 1), (4, "2024-01-05 00:00:00", "k", 0), (5, "2024-01-20 00:00:00", "k", 0)]
    df = spark.createDataFrame(rows, "tx_id bigint, ts string, device string, label int").withColumn("ts", F.col("ts").cast("timestamp"))
    entities = [Entity("device", "device", True, rates=(LabelRate(7),))]
    for hot_rows in (None, 2):
        with pytest.raises(UnfitRows, match="'no_time': 1, 'no_label': 1, 'no_id': 1, 'repeated_id': 2"):
            add_history(df, entities, ROLES, 0.5, hot_rows)
        good, bad = set_aside(df, ROLES)
        got = {r["tx_id"]: (r["device_tx_count_all"], r["device_label_n"]) for r in add_history(good, entities, ROLES, 0.5, hot_rows).collect()}
        assert got == {1: (0, 0), 5: (1, 1)}
    assert {r[0]: r[1] for r in rejected_counts(bad).collect()} == {"no_time": 1, "no_id": 1, "no_label": 1, "repeated_id": 2}


def test_the_totals_of_a_heavy_key_come_from_one_fold_and_one_join(spark):
    rows = spark.range(40).select(
        F.col("id").alias("tx_id"), F.timestamp_seconds(F.col("id") % 5).alias("ts"), F.lit(1).alias("device"),
        F.col("id").cast("double").alias("amount"), F.lit(0).alias("label"),
    )
    e = Entity("device", "device", True, (1,), age=True, amounts=True, rates=(LabelRate(1),))
    out = piecewise_statistics(rows.withColumn("_us", F.unix_micros("ts")), e, ROLES, 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1
    got = {r["tx_id"]: (r["_h_n"], r["_h_strict"]) for r in out.collect()}
    order = sorted(range(40), key=lambda i: (i % 5, i))
    assert got == {i: (at, 8 * (i % 5)) for at, i in enumerate(order)}
