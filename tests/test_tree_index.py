import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerlark.catalog import model_queries as Q
from ledgerlark.operators.metrics import core_metrics
from ledgerlark.plans import audits, scoring
from ledgerlark.plans import training as T
from ledgerlark.plans.tree_index import TreeIndex
from ledgerlark.session import pin

MODELS = {
    "boosted": T.Model("hist_gbm", "boosted", {"maxIter": 4, "maxDepth": 3, "seed": 1}),
    "forest": T.Model("forest", "forest", {"numTrees": 5, "maxDepth": 4, "seed": 1}),
}


@pytest.fixture(scope="module")
def table(spark):
    return pin(Q.feature_table(spark, SMALL))


@pytest.mark.parametrize("kind", list(MODELS))
def test_rescoring_equals_scoring_a_changed_row(table, kind):
    f, train, test = Q.features_of(table, False), table.where("split = 'train'"), table.where("split = 'test'")
    known = T.fit_encoders(train, f)
    model = T.fit(train, f, MODELS[kind], known)
    usual = known.neutral
    found = {r["tx_id"]: r["_again"] for r in scoring.occluded(model, test, f, usual).select("tx_id", "_again").collect()}
    assert len(found) == test.count() and len(next(iter(found.values()))) == len(f.names)
    for i, c in enumerate(f.names):
        if i % 4 and c not in f.text:
            continue
        value = F.lit(usual[c])
        for r in T.predict(model, test.withColumn(c, value)).select("tx_id", "score").collect():
            assert found[r["tx_id"]][i] == pytest.approx(r["score"], abs=1e-12)
    scored = T.predict(model, test)
    out = scoring.occlusion_reasons(model, scored, f, usual).collect()
    assert len(out) == len(found)
    for r in out:
        for reason in r["reason_codes"]:
            assert reason["contribution"] == pytest.approx(r["score"] - found[r["tx_id"]][f.names.index(reason["feature"])], abs=1e-12)


def test_rows_are_not_multiplied(table):
    f, train, test = Q.features_of(table, True), table.where("split = 'train'"), table.where("split = 'test'")
    known = T.fit_encoders(train, f)
    model = T.fit(train, f, MODELS["boosted"], known)
    plan = scoring.occlusion_reasons(model, T.predict(model, test), f, known.neutral)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan


def test_swapped_scores_equal_full_rescoring(table):
    f, train, test = Q.features_of(table, True), table.where("split = 'train'"), table.where("split = 'test'")
    model = T.fit(train, f, MODELS["boosted"])
    found = {r["feature"]: r["importance"] for r in audits.permutation_importance(model, test, f, repeats=1).collect()}
    base = core_metrics(T.predict(model, test), f.label, "score").first()["pr_auc"]
    rows = sorted(test.collect(), key=lambda r: r["tx_id"])
    donors = test.select("tx_id", audits.splits.seeded_hash("tx_id", 1).alias("h")).orderBy("h", "tx_id").collect()
    by_id = {r["tx_id"]: r for r in rows}
    given = {r["tx_id"]: by_id[d["tx_id"]] for r, d in zip(rows, donors)}
    for c in [n for n in f.names if found[n]][:3] + list(f.text[:1]):
        pairs = test.sparkSession.createDataFrame([(i, d[c]) for i, d in given.items()], f"_i bigint, _v {dict(test.dtypes)[c]}")
        swapped = test.join(pairs, test["tx_id"] == pairs["_i"]).withColumn(c, F.col("_v")).drop("_i", "_v")
        loss = base - core_metrics(T.predict(model, swapped), f.label, "score").first()["pr_auc"]
        assert found[c] == pytest.approx(loss, abs=1e-9)


def test_only_features_that_a_tree_tests_are_swapped(table, monkeypatch):
    f, train, test = Q.features_of(table, True), table.where("split = 'train'"), table.where("split = 'test'")
    model = T.fit(train, f, T.Model("hist_gbm", "boosted", {"maxIter": 2, "maxDepth": 2, "seed": 1}))
    sizes, rescored = [], TreeIndex.rescored

    def counted(self, *args, **kw):
        sizes.append(len(self.groups))
        return rescored(self, *args, **kw)

    monkeypatch.setattr(TreeIndex, "rescored", counted)
    found = {r["feature"]: r["importance"] for r in audits.permutation_importance(model, test, f, repeats=1).collect()}
    trees = TreeIndex.of(test.sparkSession, model.stages[-1], scoring.slot_groups(model, f))
    assert sizes == [sum(trees.tested())] and sizes[0] <= 6
    assert set(found) == set(f.names) and all(found[c] == 0.0 for c, tested in zip(f.names, trees.tested()) if not tested)
