import hashlib
import random
import threading
import time
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerlark.catalog import model_queries as Q
from ledgerlark.operators import target_statistics as O
from ledgerlark.plans import training as T
from ledgerlark.session import pin
from ledgerlark.sources import transactions as S

MODELS = (
    T.Model("logreg", "logreg", {"maxIter": 8, "C": 1.0}), T.Model("forest", "forest", {"numTrees": 3, "maxDepth": 3, "seed": 1}),
    T.Model("hist_gbm", "boosted", {"maxIter": 2, "maxDepth": 2, "seed": 1}), T.Model("ordered_gbm", "ordered", {"maxIter": 2, "maxDepth": 2, "seed": 1}),
)


@pytest.fixture(scope="module")
def table(spark):
    return pin(Q.feature_table(spark, SMALL))


@pytest.fixture(scope="module")
def store(table):
    return T.build_store(table, Q.features_of(table, False), ("logreg", "trees", "ordered"))


def scores(df):
    return {r["tx_id"]: round(r["score"], 9) for r in df.select("tx_id", "score").collect()}


@pytest.mark.parametrize("drop", [False, True])
def test_stored_models_equal_those_of_raw_rows(table, store, drop, tmp_path):
    f = Q.features_of(table, drop)
    later = store.rows.where("split <> 'train'")
    for m in MODELS:
        fitted = T.fit_stored(store, f, m)
        stored = scores(T.predict(fitted, later))
        raw = T.for_raw_rows(store, fitted, m)
        S.save_model(raw, str(tmp_path / m.name))
        again = S.load_model(str(tmp_path / m.name))
        assert stored == scores(T.predict(again, table.where("split <> 'train'"))) and len(stored) > 100


def test_stored_fit_equals_a_pipeline_of_its_own(table, store):
    f = Q.features_of(table, False)
    m = MODELS[2]
    own = T.fit(table.where("split = 'train'"), f, m, store.known)
    assert scores(T.predict(own, table.where("split = 'test'"))) == scores(T.predict(T.fit_stored(store, f, m), store.rows.where("split = 'test'")))


def test_each_fit_reads_one_vector(store, table):
    f = Q.features_of(table, True)
    plan = store.rows.where("split = 'train'").select(f.label, "weight", "trees")._jdf.queryExecution().executedPlan().toString()
    assert "logreg" not in plan.split("ReadSchema")[1] and "PartitionFilters: [isnotnull(split" in plan


def test_slices_follow_the_variant(store, table):
    full, part = Q.features_of(table, False), Q.features_of(table, True)
    for v in ("logreg", "trees", "ordered"):
        all_slots, some = store.slots(v, full), store.slots(v, part)
        size = store.rows.select(v).first()[v].size
        assert all_slots == list(range(size)) and set(some) < set(all_slots)
    assert len(store.slots("trees", part)) == len(part.names)


def evaluated(monkeypatch, table, store, fit_stored, on_fit=None):
    monkeypatch.setattr(T, "build_store", lambda *a: store)
    monkeypatch.setattr(T, "fit_stored", fit_stored)
    monkeypatch.setattr(T, "for_raw_rows", lambda store, fitted, m: fitted)
    monkeypatch.setattr(T, "predict", lambda fitted, df: df.withColumn("score", F.rand(fitted)))
    variants = {"full": Q.features_of(table, False), "demographic_free": Q.features_of(table, True)}
    return T.train_and_evaluate(table, variants, MODELS, lambda: F.lit(0.5), on_fit)


def test_fits_go_on_together_within_the_rows_that_may_be_held(table, store, monkeypatch):
    lock, now, most, order, saved = threading.Lock(), set(), [], [], []

    def fit(s, f, m):
        with lock:
            now.add(key := (m.name, len(f.names)))
            most.append(len(now))
            order.append(m.kind)
        time.sleep(0.5)
        with lock:
            now.discard(key)
        return len(order)

    got = evaluated(monkeypatch, table, store, fit, lambda name, fitted: saved.append(name))
    names = {(r["model"], r["variant"], r["split"]) for r in got.collect()}
    assert names == {(n, v, s) for n in ("rule_based", *(m.name for m in MODELS)) for v in ("full", "demographic_free") for s in ("val", "test")}
    assert max(most) == T.FITS_AT_ONCE and set(order[:4]) == {"boosted", "ordered"}
    assert sorted(saved) == sorted(f"{m.name}__{v}" for m in MODELS for v in ("full", "demographic_free"))
    for rows, at_once in ((T.ROWS_AT_ONCE // 2, 2), (T.ROWS_AT_ONCE * 5, 1)):
        most.clear()
        evaluated(monkeypatch, table, replace(store, n_train=rows), fit)
        assert max(most) == at_once


def test_a_fit_that_fails_ends_the_run_with_its_error(table, store, monkeypatch):
    begun = []

    def fit(s, f, m):
        begun.append(m.kind)
        raise ValueError(f"lost {m.kind}")

    with pytest.raises(ValueError, match="lost (ordered|boosted)"):
        evaluated(monkeypatch, table, replace(store, n_train=T.ROWS_AT_ONCE * 5), fit)
    assert len(begun) < 2 * len(MODELS)


def test_boosted_fits_have_no_tasks_of_few_rows(table, store, monkeypatch):
    f, later = Q.features_of(table, False), store.rows.where("split <> 'train'")
    rows = replace(store, rows=store.rows.repartition(6))
    parts = []
    fit = T.Pipeline.fit
    monkeypatch.setattr(T.Pipeline, "fit", lambda self, df, *a: parts.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    for m in MODELS:
        parts.clear()
        whole = scores(T.predict(T.fit_stored(rows, f, m), later))
        monkeypatch.setattr(T, "BOOSTED_TASK_ROWS", store.n_train // 2 + 1)
        halves = scores(T.predict(T.fit_stored(rows, f, m), later))
        monkeypatch.undo()
        monkeypatch.setattr(T.Pipeline, "fit", lambda self, df, *a: parts.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
        assert whole == halves
        assert parts == ([1, 2] if m.kind in ("boosted", "ordered") else [6, 6])


# -- ordered statistics ------------------------------------------------------------------------------


def drawn(n):
    rng = random.Random(3)
    return [(i, rng.choice(["x"] * 6 + ["y", None, "z\u0001"]), rng.choice(["p", "q"]), rng.randrange(2)) for i in range(n)]


@pytest.mark.parametrize("block_rows", [1, 7, 10_000])
def test_a_row_sees_only_earlier_labels_of_its_category(spark, block_rows):
    rows = drawn(150)
    train = spark.createDataFrame(rows, "id bigint, a string, b string, y int").withColumn("_id", F.lit("clash"))
    found = {r["id"]: r for r in O.ordered_statistics(train, ("a", "b"), "y", "id", 0.3, (0, 4), 2.0, block_rows).collect()}
    assert len(found) == 150
    for s in (0, 4):
        seen, hits = defaultdict(int), defaultdict(int)
        for i, a, b, y in sorted(rows, key=lambda r: (hashlib.md5(f"{s}:{r[0]}".encode()).hexdigest(), r[0])):
            for c, v in (("a", a), ("b", b)):
                assert found[i][f"{c}__o{s}"] == pytest.approx((hits[c, v] + 0.6) / (seen[c, v] + 2.0))
                seen[c, v] += 1
                hits[c, v] += y


def test_own_label_never_counts(spark):
    rows = drawn(60)
    other = [(i, a, b, 1 - y if i == 17 else y) for i, a, b, y in rows]
    one, two = (O.ordered_statistics(spark.createDataFrame(r, "id bigint, a string, b string, y int"), ("a", "b"), "y", "id", 0.3).where("id = 17").first() for r in (rows, other))
    assert one == two


def test_later_rows_get_all_training_rows(spark):
    train = spark.createDataFrame(drawn(80), "id bigint, a string, b string, y int")
    sums = O.category_sums(train, ("a",), "y")
    new = spark.createDataFrame([(1, "x"), (2, None), (3, "new")], "id bigint, a string")
    got = {r["id"]: r["a__o1"] for r in O.settled_statistics(new, ("a",), sums, 0.3).collect()}
    own = lambda v: [y for _, a, _, y in drawn(80) if a == v]
    assert got == {1: pytest.approx((sum(own("x")) + 0.3) / (len(own("x")) + 1)), 2: pytest.approx((sum(own(None)) + 0.3) / (len(own(None)) + 1)), 3: pytest.approx(0.3)}


def test_a_row_is_cut_into_pieces_once_per_order_whatever_the_columns(spark, monkeypatch):
    cut = []
    in_pieces = O.skew.in_pieces
    monkeypatch.setattr(O.skew, "in_pieces", lambda df, *a, **k: cut.append(df.count()) or in_pieces(df, *a, **k))
    train = spark.createDataFrame(drawn(30), "id bigint, a string, b string, y int")
    assert O.ordered_statistics(train, ("a", "b"), "y", "id", 0.3, (0, 4), 2.0, 7).count() == 30
    assert cut == [60]
