import json

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerlark.catalog import model_queries as Q
from ledgerlark.plans import audits, scoring
from ledgerlark.plans import training as T
from ledgerlark.session import pin
from ledgerlark.sources import transactions as S

TINY = T.Model("hist_gbm", "boosted", {"maxIter": 2, "maxDepth": 2, "seed": 1})


@pytest.fixture(scope="module")
def table(spark):
    return pin(Q.feature_table(spark, SMALL))


@pytest.fixture(scope="module")
def features(table):
    return Q.features_of(table)


def test_models_round_trip_and_score(spark, table, features, tmp_path):
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    known = T.fit_encoders(train, features)
    for m in (T.Model("logreg", "logreg", {"maxIter": 5, "C": 1.0}), TINY):
        fitted = T.fit(train, features, m, known)
        path = str(tmp_path / m.name)
        S.save_model(fitted, path)
        a = T.predict(fitted, test).select("tx_id", F.round("score", 9).alias("s"))
        b = T.predict(S.load_model(path), test).select("tx_id", F.round("score", 9).alias("s"))
        assert a.exceptAll(b).count() == 0
        out = scoring.score(test, fitted, features, {"HIGH": 0.8, "MEDIUM": 0.5}, m.name, True, known.neutral).collect()
        assert len(out) == test.count()
        for r in out:
            assert 0 <= r.fraud_score <= 1 and 1 <= len(r.reason_codes) <= 5
            sizes = [abs(c.contribution) for c in r.reason_codes]
            assert sizes == sorted(sizes, reverse=True)
            assert all((c.direction == "increases_risk") == (c.contribution > 0) for c in r.reason_codes)


def test_unseen_and_missing_values_score(spark, table, features):
    fitted = T.fit(table.where("split = 'train'"), features, T.Model("logreg", "logreg", {"maxIter": 3, "C": 1.0}))
    odd = table.where("split = 'test'").withColumn("os", F.lit("BeOS")).withColumn("amount", F.lit(None).cast("double"))
    assert T.predict(fitted, odd).where("score is null or isnan(score)").count() == 0


def test_cascade_and_importance_shapes(table, features):
    got = audits.cascade(table, features, TINY, 0.3).collect()
    assert [r.case for r in got] == ["single", "cascade"]
    fitted = T.fit(table.where("split = 'train'"), features, TINY)
    imp = audits.permutation_importance(fitted, table.where("split = 'test'"), features, repeats=2, top=5).collect()
    assert len(imp) == 5 and imp[0].importance >= imp[-1].importance


def space(rng):
    return {"maxIter": rng.randint(1, 2), "maxDepth": rng.randint(1, 2), "stepSize": rng.random()}


def test_search_is_ordered_and_repeatable(table, features):
    runs = [[tuple(map(str, r)) for r in T.search(table, features, TINY, space, trials=2).collect()] for _ in range(2)]
    assert runs[0] == runs[1] and float(runs[0][0][4]) >= float(runs[0][1][4])


def test_a_search_goes_on_from_its_ledger(spark, table, features, tmp_path, monkeypatch):
    ledger = str(tmp_path / "trials")
    assert T.best_parameters(spark, ledger) is None
    fitted, real = [], T.fit_stored

    def watched(store, f, model):
        fitted.append(dict(model.params))
        if len(fitted) == 2:
            raise ValueError("lost")
        return real(store, f, model)

    monkeypatch.setattr(T, "fit_stored", watched)
    first = {r["trial"]: r for r in T.search(table, features, TINY, space, trials=3, parallel=1, ledger=ledger).collect()}
    assert [first[i]["status"] for i in range(3)] == ["done", "failed", "done"] and "lost" in first[1]["error"]
    again = T.search(table, features, TINY, space, trials=4, parallel=1, ledger=ledger).collect()
    assert len(fitted) == 5 and [r["status"] for r in again] == ["done"] * 4  # trial 1 once more, and trial 3
    assert {r["trial"]: r["params"] for r in again if r["trial"] < 3} == {i: r["params"] for i, r in first.items()}
    assert T.search(table, features, TINY, space, trials=4, ledger=ledger).count() == 4 and len(fitted) == 5
    best = T.best_parameters(spark, ledger)
    assert best == json.loads(again[0]["params"]) and set(best) == {"maxIter", "maxDepth", "stepSize"}
    tuned = {m.name: m for m in T.standard_models(best)}["hist_gbm"]
    assert tuned.params["stepSize"] == best["stepSize"] and tuned.params["minInstancesPerNode"] == T.BOOSTED["minInstancesPerNode"]


def many_valued(spark, n=120_000, levels=50_000):
    """A text feature with ``levels`` values, the first of them frequent, and one with three."""
    rows = spark.range(n).selectExpr(
        "id as tx_id", "timestamp_seconds(1700000000 + id) as ts", "cast(id % 7 as double) as x",
        f"case when id % 50 = 1 then null when id % 3 = 0 then 'v' || id % 40 else concat('k', id % {levels}) end as wide",
        "case when id % 11 = 0 then 'q\\'\\\\`uote' when id % 2 = 0 then 'b' else 'c' end as few",
        "cast(id % 7 + id % 3 > 6 as int) as label", "'train' as split",
    )
    return pin(rows), T.Features(("x",), ("wide", "few"))


def test_fifty_thousand_levels_fit_save_load_and_score(spark, tmp_path):
    train, f = many_valued(spark)
    known = T.fit_encoders(train, f)
    assert known.levels.levels["wide"] > 30_000 and known.levels.levels["few"] == 3
    odd = train.withColumn("wide", F.when(F.col("tx_id") % 5 == 0, "never seen").otherwise(F.col("wide")))
    for m in (T.Model("logreg", "logreg", {"maxIter": 3, "C": 1.0}), T.Model("hist_gbm", "boosted", {"maxIter": 2, "maxDepth": 3, "seed": 1})):
        fitted = T.fit(train, f, m, known)
        path = str(tmp_path / m.name)
        S.save_model(fitted, path)
        scored = T.predict(fitted, odd).select("tx_id", F.round("score", 9).alias("s"))
        again = T.predict(S.load_model(path), odd).select("tx_id", F.round("score", 9).alias("s"))
        assert scored.count() == odd.count() and scored.where("s is null or isnan(s)").count() == 0
        assert scored.exceptAll(again).count() == 0


def test_levels_are_numbered_by_frequency_and_rare_ones_together(spark):
    rows = [("a",)] * 30 + [("b",)] * 40 + [("c",)] * 3 + [("d",)] * 2 + [(None,)] * 15
    train = spark.createDataFrame(rows, "t string").withColumn("u", F.lit(None).cast("string"))
    found = T.fit_encoders(train, T.Features((), ("t", "u"))).levels
    table = {(r["feature"], r["level"]): (r["n"], r["rare"], r["place"], r["rank"]) for r in found.table.collect()}
    assert table == {
        ("t", "b"): (55, False, 0, 0), ("t", "a"): (30, False, 1, 1), ("t", "c"): (3, True, 2, 2), ("t", "d"): (2, True, 2, 3), ("u", "NA"): (90, False, 0, 0),
    }
    assert found.modes == {"t": "b"} and found.names["t"] == ["b", "a", "_RARE_"]


def test_no_level_stands_in_the_plan(spark, table, features):
    known = T.fit_encoders(table.where("split = 'train'"), features)
    plan = T.build_pipeline(table, features, T.Model("logreg", "logreg", {"maxIter": 3, "C": 1.0}), known).getStages()
    assert [type(s).__name__ for s in plan][:2] == ["SQLTransformer", "LevelEncoder"]
    assert not any(v in plan[0].getStatement() for v in known.levels.names[features.text[0]] if v)


def test_forest_keeps_the_nodes_of_rows_between_passes(features):
    forest = T.classifier(features, T.Model("random_forest", "forest", T.FOREST), lambda: 1)
    assert forest.getCacheNodeIds()
    assert {p: forest.getOrDefault(p) for p in T.FOREST} == T.FOREST


def test_train_eval_fits_its_models_at_their_full_parameters(spark, table, monkeypatch):
    given = []
    monkeypatch.setattr(Q, "feature_table", lambda *a: table)
    monkeypatch.setattr(Q.T, "train_and_evaluate", lambda t, variants, models, *a: given.extend([sorted(variants), *models]))
    monkeypatch.setattr(Q.reports, "model_comparison", lambda metrics: metrics)
    Q.train_eval(spark, SMALL)
    variants, *models = given
    assert variants == ["demographic_free", "full"]
    assert {m.name: dict(m.params) for m in models} == {
        "logreg": T.LOGREG, "random_forest": T.FOREST, "hist_gbm": {**T.BOOSTED, **T.BOOSTED_TUNED}, "ordered_gbm": T.BOOSTED_ORDERED,
    }
    assert [m.params["maxIter"] for m in models if m.kind in ("boosted", "ordered")] == [600, 600]


def test_cases_of_an_audit_share_one_encoding(table, features, monkeypatch):
    fits = []
    fit_encoders = T.fit_encoders
    monkeypatch.setattr(T, "fit_encoders", lambda *a: fits.append(a) or fit_encoders(*a))
    got = audits.rate_ablation(table, features, TINY).collect()
    assert len(fits) == 1
    monkeypatch.undo()
    part = features.without([c for c in features.names if "fraud_rate" in c or c.endswith("_label_n")])
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    for row, f in zip(got, (features, part)):
        alone = audits._result(T.predict(T.fit(train, f, TINY), test), f, row.case)
        assert tuple(row) == pytest.approx(alone)


def test_folds_and_top_rows_number_narrow_rows(spark, monkeypatch):
    widths = []
    for module in (audits, audits.splits):
        number_rows = module.number_rows
        monkeypatch.setattr(module, "number_rows", lambda df, *a, _f=number_rows: widths.append(len(df.columns)) or _f(df, *a))
    monkeypatch.setattr(audits, "fit", lambda *a: None)
    monkeypatch.setattr(audits, "predict", lambda model, df: df.withColumn("score", F.lit(0.5)))
    rows = [(i, 100 - i // 2, "train", i % 2, float(i % 5), "x") for i in range(40)]
    df = spark.createDataFrame(rows, "tx_id bigint, ts bigint, split string, label int, a double, b string")
    f = T.Features(("a",), ("b",))
    oof = audits.out_of_fold(df, f, TINY).collect()
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r.tx_id: r.fold for r in oof} == {r[0]: i // 10 for i, r in enumerate(order)}
    scored = df.withColumn("score", F.col("a"))
    best = sorted(rows, key=lambda r: (-r[4], r[1], r[0]))
    for k in (0, 1, 11, 40):
        got = audits._top_share(scored, f, k)
        assert got.columns == scored.columns and {r.tx_id for r in got.collect()} == {r[0] for r in best[:k]}
    assert max(widths) <= 3
