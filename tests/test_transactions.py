"""The whole run on a table with the full set of columns."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerlark.catalog.views import tx_events
from ledgerlark.operators.splits import TimeSplit
from ledgerlark.plans import reports, scoring
from ledgerlark.plans import training as T
from ledgerlark.plans import transactions as X
from ledgerlark.sources import transactions as S
from ledgerlark.streaming import jobs

BOUNDS = TimeSplit("2024-01-20 23:59:59", "2024-01-21 00:00:00", "2024-01-25 23:59:59", "2024-01-26 00:00:00", "2024-01-31 00:00:00")
MODELS = (
    T.Model("logreg", "logreg", {"maxIter": 5, "C": 1.0}),
    T.Model("hist_gbm", "boosted", {"maxIter": 2, "maxDepth": 2, "seed": 1}),
)


def transactions(spark):
    c = F.col
    text = lambda name, n: F.concat(F.lit(name), (c("tx_id") % n).cast("string"))
    cols = {
        "BusinessKey": F.format_string("k%06d", c("tx_id")), "AccountNumber": c("account").cast("bigint"), "TransactionDate": c("ts"),
        "TransactionType": F.element_at(F.array(*[F.lit(v) for v in ("Fast", "Havale", "Eft")]), (c("tx_id") % 3 + 1).cast("int")),
        "TransactionChannel": F.lit("Mobile"), "ReceiverName": c("receiver").cast("string"), "SenderName": c("sender").cast("string"),
        "IsFraudTransaction": c("label"), "HasMobileActivationL1H": c("l1h"), "HasMobileActivationL8H": c("l8h"), "DayType": c("day_type"),
        "CustomerName": text("c", 40), "CustomerSegment": c("segment"), "CustomerAge": (c("tx_id") % 80 + 18).cast("int"),
        "CustomerTenure": (c("tx_id") % 240).cast("double"), "CustomerEducation": F.when(c("tx_id") % 60 > 0, text("e", 5)),
        "CustomerProfession": text("p", 12), "CustomerMaritalStatus": text("m", 4), "CustomerGender": text("g", 2),
        "IsFractionalAmount": c("is_fractional"), "TransactionAmount": c("amount"), "DeviceModel": text("SM-", 130), "DeviceOSName": c("os"),
        "DeviceId": c("device").cast("string"), "IP_Subnet": c("subnet").cast("string"), "UniqueIPCount": (c("tx_id") % 7).cast("int"),
    }
    return tx_events(spark, SMALL).select(*[v.alias(k) for k, v in cols.items()])


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    tx = transactions(spark)
    assert S.type_differences(tx) == []
    tx.write.parquet(str(folder / "tx"))
    X.train(spark, str(folder / "tx"), str(folder / "out"), X.FeatureOptions(BOUNDS), MODELS)
    return folder


def test_training_run(spark, run):
    out = str(run / "out")
    table = spark.read.parquet(f"{out}/features")
    f = X.model_features(table, True)
    assert len(f.names) == 56 and len(X.model_features(table, False).names) == 60
    assert table.select("DeviceModel").distinct().count() == 101
    metrics = spark.read.parquet(f"{out}/metrics")
    comparison = reports.model_comparison(metrics).collect()
    assert len(comparison) == 6 and [r.pr_auc for r in comparison] == sorted((r.pr_auc for r in comparison), reverse=True)
    cut = S.load_parameters(spark, f"{out}/cutoffs")
    assert cut["best_model"].endswith("demographic_free") and cut["HIGH"] >= cut["MEDIUM"]
    same = X.compare(spark, out, out).collect()
    assert len(same) == 6 and all(r.pr_auc_delta == 0 for r in same)


def test_requests_score_like_the_table(spark, run):
    """A request that sends the history of its row gets the score of that row."""
    out = str(run / "out")
    cut = S.load_parameters(spark, f"{out}/cutoffs")
    model = S.load_model(f"{out}/models/{cut['best_model']}")
    table = spark.read.parquet(f"{out}/features").where("split = 'test'")
    f = X.model_features(table, True)
    sent = F.map_from_arrays(
        F.array(*[F.lit(n) for n in scoring.REQUEST_HISTORY]), F.array(*[F.col(n).cast("double") for n in scoring.REQUEST_HISTORY])
    )
    raw = transactions(spark).join(table.select("BusinessKey", sent.alias("historical_features")), "BusinessKey")
    requests = raw.select(*S.SCORE_REQUEST.names)
    top = spark.read.json(f"{out}/top_models")
    got = scoring.score_requests(requests, model, f, cut["prior"], top, {k: cut[k] for k in ("HIGH", "MEDIUM")}, cut["best_model"])
    want = T.predict(model, table)
    both = got.join(want.select("BusinessKey", "score"), "BusinessKey")
    assert both.count() == table.count() > 0
    assert both.where(F.abs(F.col("fraud_score") - F.col("score")) > 1e-9).count() == 0


def test_model_scores_a_stream(spark, run):
    out = str(run / "out")
    model = S.load_model(f"{out}/models/logreg__full")
    table = spark.read.parquet(f"{out}/features")
    stream = spark.readStream.schema(table.schema).parquet(f"{out}/features")
    scored = jobs.score_stream(stream, model, {"HIGH": 0.9, "MEDIUM": 0.6}).select("BusinessKey", "fraud_score", "risk_band")
    jobs.write_stream(scored, str(run / "s"), str(run / "c")).awaitTermination()
    assert spark.read.parquet(str(run / "s")).count() == table.count()


def test_profile(spark, run):
    tables = X.profile_tables(S.read_table(spark, str(run / "tx")))
    rows = {name: t.collect() for name, t in tables.items()}
    assert rows["schema"][0].ok
    total = rows["basic"][0].n_rows
    assert sum(r.n for r in rows["quarterly"]) == total
    assert {r["column"] for r in rows["missing"]} == {"DayType", "CustomerEducation"}
    assert sum(r.n for r in rows["breakdown"] if r["column"] == "CustomerSegment") == total
    assert rows["duplicate_keys"][0].duplicates_key == 0 and len(rows["entities"]) == 6


def test_audits(spark, run):
    from ledgerlark.plans.audits import audit_tables

    table = spark.read.parquet(str(run / "out" / "features"))
    f = X.model_features(table, True)
    got = audit_tables(table, f, X.TRANSACTION_ENTITIES, X.ROLES, "ReceiverName", MODELS[1], MODELS[1], (1, 7))
    rows = {name: t.collect() for name, t in got.items()}
    assert [r.case for r in rows["lags"]] == ["lag_1d", "lag_7d"]
    assert rows["rate_ablation"][0].n_features - rows["rate_ablation"][1].n_features == 4
    assert rows["drift"][0].grade in ("none", "mild", "marked", "severe", "critical")
    assert len(rows["drift_features"]) == len(f.names) and len(rows["cascade"]) == 2


def test_command_line(spark, run):
    from ledgerlark.__main__ import main

    out = str(run / "out")
    main(["profile", str(run / "tx"), str(run / "profile")])
    assert spark.read.json(str(run / "profile" / "basic")).first().n_rows == spark.read.parquet(str(run / "tx")).count()
    requests = transactions(spark).limit(50).withColumn("historical_features", F.lit(None).cast("map<string,double>"))
    requests = requests.withColumn("CustomerAge", F.when(F.col("BusinessKey") == requests.first().BusinessKey, 200).otherwise(F.col("CustomerAge")))
    requests.select(*S.SCORE_REQUEST.names).write.parquet(str(run / "requests"))
    main(["score", str(run / "requests"), out, str(run / "scored"), "--explain"])
    assert spark.read.parquet(str(run / "scored" / "scores")).where("size(reason_codes) > 0").count() == 49
    assert spark.read.parquet(str(run / "scored" / "rejected")).first().violations == ["CustomerAge_range"]
    main(["compare", out, out])


def test_train_uses_the_best_trial_of_a_search(spark, run, tmp_path, monkeypatch):
    rows = [(0, 42, '{"maxIter": 3, "stepSize": 0.25}', "done", 0.5, None), (1, 42, '{"maxIter": 9}', "failed", None, "x"), (2, 42, '{"maxIter": 2}', "done", 0.4, None)]
    spark.createDataFrame(rows, T._LEDGER).write.json(str(tmp_path / "tuned" / "trials"))
    seen = []

    def models(tuned=None):
        seen.append(tuned)
        return MODELS[1:]

    monkeypatch.setattr(X, "standard_models", models)
    X.train(spark, str(run / "tx"), str(tmp_path / "out"), X.FeatureOptions(BOUNDS), trials=str(tmp_path / "tuned" / "trials"))
    assert seen == [{"maxIter": 3, "stepSize": 0.25}]
