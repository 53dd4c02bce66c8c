import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import metrics as M
from ledgerlark.operators import ordered as O
from ledgerlark.operators import splits as S

GOLDEN = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.5), (1, 0.4), (0, 0.1), (0, 0.1)]


def frame(spark, rows):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(rows)], "id long, y int, s double")


def test_golden_areas(spark):
    got = M.core_metrics(frame(spark, GOLDEN), "y", "s").first()
    assert got.roc_auc == pytest.approx(0.791667, abs=1e-6)
    assert got.pr_auc == pytest.approx(0.755556, abs=1e-6)
    assert (got.n, got.n_positives) == (7, 3)


def test_one_class_has_no_area(spark):
    got = M.core_metrics(frame(spark, [(0, 0.1), (0, 0.2)]), "y", "s").first()
    assert got.roc_auc is None and got.pr_auc is None


@pytest.mark.parametrize("seed, distinct", [(1, 3), (2, 40), (3, 1)])
def test_budgets_match_a_sort(spark, seed, distinct):
    rng = random.Random(seed)
    rows = [(int(rng.random() < 0.3), rng.randrange(distinct) / distinct) for _ in range(300)]
    budgets = [M.Budget("percentile", f) for f in (0.001, 0.01, 0.05, 0.0117, 1.0)] + [M.Budget("alerts_per_day", 7.0), M.Budget("alerts_per_day", 999.0)]
    got = M.budget_rows(frame(spark, rows), "y", "s", ("id",), budgets, days=5)
    order = sorted(range(300), key=lambda i: (-rows[i][1], i))
    for b, r in zip(budgets, got):
        share = b.k if b.perspective == "percentile" else min(300, max(1, int(b.k) * 5)) / 300
        k = max(1, round(300 * share))
        tp = sum(rows[i][0] for i in order[:k])
        assert (r["n_alerts"], r["tp"], r["fp"]) == (k, tp, k - tp)
        assert r["threshold"] == rows[order[k - 1]][1]
        assert r["fn"] == sum(y for y, _ in rows) - tp


def test_thresholds(spark):
    got = M.at_fixed_thresholds(frame(spark, GOLDEN), "y", "s", (0.8, 2.0)).orderBy("threshold").collect()
    assert (got[0].tp, got[0].fp, got[0].fn, got[0].tn) == (2, 1, 1, 3)
    assert got[0].f2 == pytest.approx(5 * 2 / (5 * 2 + 4 * 1 + 1))
    assert (got[1].precision, got[1].recall, got[1].f1) == (0.0, 0.0, 0.0)


def test_row_numbers_and_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    assert [r.rn for r in O.number_rows(df, ["v"]).orderBy("v").collect()] == list(range(1, 1001))
    got = O.running_totals(df.withColumn("one", F.lit(1)), ["v"], {"upto": "one"}, by=["g"]).orderBy("g", "v").collect()
    seen = {}
    for r in got:
        seen[r.g] = seen.get(r.g, 0) + 1
        assert r.upto == seen[r.g]


def test_percentiles_match_the_builtin(spark):
    df = spark.range(997).select((F.pow(F.col("id") * 31 % 997, F.lit(1.3))).alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    got = {(r["feature"], r["prob"]): r["value"] for r in O.exact_percentiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    for c in ("a", "b"):
        for p in (0.0, 0.25, 0.5, 0.99, 1.0):
            assert got[c, p] == pytest.approx(df.select(F.percentile(c, F.lit(p))).first()[0], rel=1e-12)


def test_splits(spark):
    df = spark.range(5000).withColumn("y", (F.col("id") % 10 == 0).cast("int")).withColumn("ts", F.timestamp_seconds("id"))
    again = S.random_split(df.repartition(7), "id").groupBy("split").count().collect()
    first = S.random_split(df, "id").groupBy("split").count().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first))
    shares = {r.split: r["count"] / 5000 for r in first}
    assert math.isclose(shares["test"], 0.2, abs_tol=0.02) and math.isclose(shares["val"], 0.1, abs_tol=0.02)
    strat = {(r.y, r.split): r["count"] for r in S.stratified_split(df, "id", "y").groupBy("y", "split").count().collect()}
    assert strat[1, "test"] == 100 and strat[1, "val"] == 50 and strat[0, "test"] == 900
    mixed = S.reshuffle(df, ["y"], "ts", "id", 3, F.col("id") < 4000)
    assert mixed.where("id < 4000").agg(F.sum("y")).first()[0] == 400
    assert mixed.where("id >= 4000").join(df, ["id", "y"]).count() == 1000
    assert mixed.join(df, ["id", "y"]).count() < 4700


def test_null_scores_are_refused(spark):
    with pytest.raises(ValueError, match="1 rows have no score"):
        M.budget_rows(frame(spark, [(1, 0.5), (0, 0.1)]).withColumn("s", F.when(F.col("y") == 1, F.col("s"))), "y", "s", ("id",), [M.Budget("percentile", 0.5)])


def test_quantiles_of_larger_tables_sort_only_what_is_between_bounds(spark, monkeypatch):
    i = F.col("id")
    df = spark.range(120_000).select(
        (F.xxhash64(i) / 1e15).alias("a"), (i % 7).cast("int").alias("b"), F.when(i % 3 == 0, i).alias("c"), F.lit(0).alias("d"), F.when(i % 2 == 0, -1.5).otherwise(2.5).alias("e"),
    )
    names, probs = df.columns, [0.25, 0.5, 0.99]
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    wanted = sorted(map(tuple, O.group_percentiles(doubles.unpivot([], names, "feature", "v"), "feature", "v", probs).collect()))

    def whole(*_, **__):
        raise AssertionError("all values of a column were sorted")

    monkeypatch.setattr(O, "group_percentiles", whole)
    assert sorted(map(tuple, O.exact_percentiles(df, names, probs).collect())) == wanted


def test_quantiles_outside_their_bounds_are_taken_from_all_values(spark, monkeypatch):
    df = spark.range(1_000).select(F.col("id").cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    monkeypatch.setattr(O, "_bounds", lambda *_: {("a", 0.5): (100.0, 200.0), ("a", 0.25): (200.0, 300.0)})
    got = {(r["feature"], r["prob"]): r["value"] for r in O.exact_percentiles(df, ["a", "b"], [0.25, 0.5]).collect()}
    assert got == {("a", 0.25): 249.75, ("a", 0.5): 499.5}
