import random

import pytest

from ledgerlark.operators.asof import asof_join
from ledgerlark.operators.skew import in_pieces


def drawn(seed, n):
    """Rows of (id, key, us, value): one key has half of them, times are few, ids repeat, keys and times miss."""
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.choice(["a"] * 5 + ["b", "c", None]), rng.choice([None, *range(0, 60, 5)]), rng.randrange(9)) for _ in range(n)]


def tables(spark, seed):
    schema = "id bigint, key string, s bigint, v int"
    rows, snaps = (spark.createDataFrame(drawn(seed + k, 150), schema).selectExpr("id", "key", "timestamp_seconds(s) as ts", "v", "'x' as _snap", "1 as _piece") for k in (0, 1))
    return rows, snaps


@pytest.mark.parametrize("hot_rows, block_rows", [(None, 10), (1, 1), (1, 7), (40, 7), (1, 10_000)])
def test_newest_snapshot_counts(spark, hot_rows, block_rows):
    rows, snaps = tables(spark, 5)
    out = asof_join(rows, snaps.drop("_snap", "_piece"), "key", "ts", ("id", "v"), "id", hot_rows=hot_rows, block_rows=block_rows)
    got = sorted(map(repr, ((r["id"], r["key"], r["ts"], r["v"], r["asof_id"], r["asof_v"]) for r in out.collect())))
    held = [r for r in snaps.collect() if r["key"] is not None and r["ts"] is not None]
    want = []
    for r in rows.collect():
        fit = [(s["ts"], s["id"], s["v"]) for s in held if r["ts"] is not None and s["key"] == r["key"] and s["ts"] <= r["ts"]]
        best = max(fit, default=(None, None, None))
        want.append(repr((r["id"], r["key"], r["ts"], r["v"], *best[1:])))
    assert got == sorted(want)


def test_rows_do_not_ride_along(spark):
    rows, snaps = tables(spark, 1)
    plan = asof_join(rows, snaps.drop("_snap", "_piece"), "key", "ts", ("v",), "id", hot_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert "_row" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_pieces_are_bounded_and_in_order(spark):
    df = spark.range(1000).selectExpr("'k' as k", "id % 3 as t", "id")
    found = in_pieces(df, "k", [df["t"], df["id"]], 30).collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r["_piece"], []).append((r["t"], r["id"]))
    assert max(map(len, sizes.values())) <= 30
    flat = [x for p in sorted(sizes) for x in sorted(sizes[p])]
    assert flat == sorted(flat) and len(flat) == 1000


def test_empty_tables(spark):
    rows, snaps = tables(spark, 2)
    none = snaps.drop("_snap", "_piece").limit(0)
    out = asof_join(rows, none, "key", "ts", ("v",), "id")
    assert out.count() == 150 and out.where("asof_v is not null").count() == 0
    assert asof_join(rows.limit(0), none, "key", "ts", ("v",), "id", hot_rows=1).count() == 0
