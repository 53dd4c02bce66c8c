import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators.history import Entity, LabelRate, Roles
from ledgerlark.plans.requests import history_totals, request_history

ROLES = Roles("tx_id", "ts", "amount", "label")
E = Entity("dev", "device", True, (1, 3), (("receivers", "receiver"),), True, True, True, rates=(LabelRate(1), LabelRate(1, 5.0, 2, "_w2")))
SCHEMA = "tx_id bigint, device string, receiver int, hour int, amount double, label int"


def drawn(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice(["a"] * 6 + ["b", None]), rng.randrange(5), rng.choice([0, 24, 24, 30, 48, 71, 96, 120]), float(rng.randrange(1, 900)), rng.randrange(2)) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("hour") * 3600 + 1_700_000_000)).drop("hour")


@pytest.mark.parametrize("hot_rows, block_rows", [(None, 10_000), (1, 1), (1, 3)])
def test_requests_see_all_strictly_older_rows(spark, hot_rows, block_rows):
    held = drawn(1, 90)
    asks = [*drawn(2, 25), (900, "new", 1, 50, 7.0, 0), *drawn(2, 3)]
    totals = history_totals(table(spark, held), E, ROLES, 400.0, block_rows)
    requests = table(spark, asks).withColumn("n", F.lit("clash"))
    found = request_history(requests, {"dev": totals}, (E,), 0.1, ROLES, 400.0, hot_rows, block_rows).collect()
    assert len(found) == len(asks)
    want = {a: a for a in asks}
    for r in found:
        hour = (int(r["ts"].timestamp()) - 1_700_000_000) // 3600
        ask = next(a for a in want if (a[0], a[1], a[3], a[4]) == (r["tx_id"], r["device"], hour, r["amount"]))
        old = [h for h in held if ask[1] is not None and h[1] == ask[1] and h[3] < ask[3]]
        a = [h[4] for h in old]
        mean = sum(a) / len(a) if a else 0.0
        assert r["dev_tx_count_all"] == len(old) and r["dev_is_first_seen"] == int(not old)
        for w in (1, 3):
            assert r[f"dev_tx_count_{w}d"] == sum(h[3] >= ask[3] - 24 * w for h in old)
        assert r["dev_distinct_receivers_all"] == len({h[2] for h in old})
        assert r["dev_first_seen_days_ago"] == pytest.approx((ask[3] - min([h[3] for h in old], default=ask[3])) / 24)
        assert r["dev_amount_mean_prev"] == pytest.approx(mean) and r["dev_amount_max_prev"] == max(a, default=0.0)
        assert r["dev_amount_std_prev"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in a) / len(a)) if a else 0.0, abs=1e-6)
        assert r["dev_amount_ratio_to_mean"] == pytest.approx(ask[4] / mean if mean else 1.0)
        for suffix, strength, span in (("", 50.0, 10**6), ("_w2", 5.0, 48)):
            known = [h for h in old if ask[3] - 24 - span <= h[3] < ask[3] - 24]
            assert r[f"dev_label_n{suffix}"] == len(known)
            assert r[f"dev_fraud_rate_smoothed{suffix}"] == pytest.approx((sum(h[5] for h in known) + strength * 0.1) / (len(known) + strength))


def test_totals_have_one_row_per_key_and_time(spark):
    found = history_totals(table(spark, drawn(3, 60)), E, ROLES, block_rows=2)
    assert found.groupBy("key", "at").count().where("count > 1").count() == 0
    assert found.groupBy("key").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == sum(r[1] is not None for r in drawn(3, 60))


def test_empty_history_and_requests(spark):
    none, some = table(spark, []), table(spark, drawn(4, 5))
    got = request_history(some, {"dev": history_totals(none, E, ROLES)}, (E,), 0.1, ROLES)
    assert got.count() == 5 and got.where("dev_tx_count_all > 0 or dev_is_first_seen = 0").count() == 0
    assert request_history(none, {"dev": history_totals(some, E, ROLES)}, (E,), 0.1, ROLES).count() == 0


def test_answers_are_gathered_without_another_join(spark):
    totals = history_totals(table(spark, drawn(5, 30)), E, ROLES)
    # first meetings are folded by hash, not sorted on the map side
    assert "SortAggregate" not in totals._jdf.queryExecution().toString()
    found = request_history(table(spark, drawn(6, 10)), {"dev": totals}, (E,), 0.1, ROLES)
    assert "_a_id" not in found._jdf.queryExecution().toString()
