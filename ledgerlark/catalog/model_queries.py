"""Fitted models on the event view. The label follows from type and amount, so the type is left out."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import EFT, RULES, over
from ledgerlark.catalog.views import ENTITIES, ROLES, tx_events
from ledgerlark.functions import rows as R
from ledgerlark.operators.history import add_history, label_prior, with_label_rates
from ledgerlark.plans import audits, reports, scoring
from ledgerlark.plans import training as T
from ledgerlark.session import pin, scratch_folder
from ledgerlark.sources.transactions import load_model, save_model, save_parameters
from ledgerlark.streaming import jobs

COLUMN_ROLES = {
    "tx_id": "id", "ts": "time", "label": "label", "split": "split", "day_type": "raw", "tx_type": "raw", "segment": "demographic",
    **{e: "key" for e in ("device", "receiver", "sender", "account", "subnet")},
}
# boosting takes some 0.25 to 0.75 s a round here on small tables (README), so queries with these models run few of the
# rounds of plans.training; linear models and all models of train_eval have their full parameters
BOOSTED = T.Model("hist_gbm", "boosted", {"maxIter": 5, "maxDepth": 3, "stepSize": 0.2, "seed": 42})
FOREST = T.Model("random_forest", "forest", {"numTrees": 10, "maxDepth": 5, "minInstancesPerNode": 20, "seed": 42})
ORDERED = T.Model("ordered_gbm", "ordered", BOOSTED.params)
LOGREG = T.Model("logreg", "logreg", T.LOGREG)


def feature_table(spark: SparkSession, sf_dir: str, rates: bool = True) -> DataFrame:
    tx = tx_events(spark, sf_dir)
    cols = R.RowColumns("amount", "ts", "day_type", "os", (("os_l1h", "l1h"), ("os_l8h", "l8h")), None)
    entities = with_label_rates(ENTITIES) if rates else ENTITIES
    return add_history(R.add_row_features(tx, cols), entities, ROLES, label_prior(tx, "label", "train") if rates else None)


def features_of(table: DataFrame, drop_demographic: bool = True) -> T.Features:
    num, text = R.feature_columns(table, COLUMN_ROLES, drop_demographic)
    return T.Features(tuple(num), tuple(text))


def _table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, T.Features]:
    table = pin(feature_table(spark, sf_dir))
    return table, features_of(table)


def train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and the four fitted models, at their full parameters, with and without the demographic feature."""
    table = pin(feature_table(spark, sf_dir))
    variants = {"full": features_of(table, False), "demographic_free": features_of(table, True)}
    metrics = T.train_and_evaluate(table, variants, T.standard_models(), lambda: R.rule_score(RULES, EFT))
    return reports.model_comparison(metrics)


def ordered_rates_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on ordered statistics of the categories instead of category codes."""
    table, f = _table(spark, sf_dir)
    return T.train_and_evaluate(table, {"full": features_of(table, False), "demographic_free": f}, (ORDERED,))


def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test row scored, banded and explained by a linear model."""
    table, f = _table(spark, sf_dir)
    fitted = T.fit(table.where("split = 'train'"), f, LOGREG)
    out = scoring.score(table.where("split = 'test'"), fitted, f, {"HIGH": 0.9, "MEDIUM": 0.6}, "logreg__demographic_free", True)
    return out.drop("score_calculated_at").withColumn("reason_codes", F.to_json("reason_codes"))


def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows scored by a fitted pipeline, counted, and how many the saved and loaded pipeline scores alike."""
    table, f = _table(spark, sf_dir)
    fitted = T.fit(table.where("split = 'train'"), f, LOGREG)
    folder, test = scratch_folder(spark, "model"), table.where("split = 'test'")
    save_model(fitted, f"{folder}/logreg")
    first = T.predict(fitted, test).select("tx_id", F.round("score", 12).alias("score"))
    again = T.predict(load_model(f"{folder}/logreg"), test).select("tx_id", F.round("score", 12).alias("score"))
    same = first.join(again, ["tx_id", "score"], "left_semi")
    return first.agg(F.count(F.lit(1)).alias("n_scored")).crossJoin(same.agg(F.count(F.lit(1)).alias("n_equal")))  # one row each


def stream_score_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows scored in micro-batches by a fitted model, counted, and how many equal the batch scores."""
    table, f = _table(spark, sf_dir)
    fitted = T.fit(table.where("split = 'train'"), f, LOGREG)
    folder, test = scratch_folder(spark, "model-stream"), table.where("split = 'test'")
    test.repartition(4, "tx_id").write.parquet(f"{folder}/in")
    save_parameters(spark, {"HIGH": 0.9, "MEDIUM": 0.6}, f"{folder}/cutoffs")
    rows = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.score_micro_batches(rows, fitted, f, f"{folder}/cutoffs", f"{folder}/out", f"{folder}/checkpoint", "logreg").awaitTermination()
    columns = ("tx_id", "fraud_score", "risk_band", "is_fraud", "action", "threshold_used")
    streamed = spark.read.parquet(f"{folder}/out").select(*columns, F.lit(True).alias("streamed"))
    batch = scoring.score(test, fitted, f, {"HIGH": 0.9, "MEDIUM": 0.6}).select(*columns)
    same = streamed.join(batch, list(columns), "left_semi")
    return streamed.agg(F.count(F.lit(1)).alias("n_streamed")).crossJoin(same.agg(F.count(F.lit(1)).alias("n_equal")))  # one row each


def score_explain_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occlusion reasons of a boosted model for every test row."""
    table, f = _table(spark, sf_dir)
    train = table.where("split = 'train'")
    known = T.fit_encoders(train, f)
    fitted = T.fit(train, f, BOOSTED, known)
    out = scoring.score(table.where("split = 'test'"), fitted, f, None, "hist_gbm", True, known.neutral)
    return out.drop("score_calculated_at").withColumn("reason_codes", F.to_json("reason_codes"))


def drift_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, f = _table(spark, sf_dir)
    return audits.drift_classifier(table, f, BOOSTED)[0]


def drift_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, f = _table(spark, sf_dir)
    _, fitted, held = audits.drift_classifier(table, f, BOOSTED)
    flagged = T.Features(f.numeric, f.text, "is_test")
    return audits.permutation_importance(fitted, held, flagged, "roc_auc", repeats=3)


def test_like_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, f = _table(spark, sf_dir)
    _, fitted, _ = audits.drift_classifier(table, f, BOOSTED)
    return audits.test_like_rows(table, f, fitted)


def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, f = _table(spark, sf_dir)
    fitted = T.fit(table.where("split = 'train'"), f, FOREST)
    return audits.permutation_importance(fitted, table.where("split = 'test'"), f, repeats=3)


def leakage_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = pin(feature_table(spark, sf_dir, rates=False))
    entities = with_label_rates(ENTITIES)
    f = features_of(base)
    rate = tuple(f"{e}_{n}" for e in ("device", "receiver") for n in ("fraud_rate_smoothed", "label_n"))
    return audits.permutation_test(base, T.Features(f.numeric + rate, f.text), entities, ROLES, BOOSTED)


def lag_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = pin(feature_table(spark, sf_dir, rates=False))
    return audits.lag_sensitivity(base, features_of(base), ENTITIES, ROLES, BOOSTED, (7, 14, 21, 28))


def rate_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, f = _table(spark, sf_dir)
    return audits.rate_ablation(table, f, BOOSTED)


def seen_unseen_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, f = _table(spark, sf_dir)
    return audits.seen_and_unseen(table, f, BOOSTED, "account")


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, f = _table(spark, sf_dir)
    return audits.cascade(table, f, BOOSTED, 0.05)


def tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three trials of the search with few iterations."""
    table, f = _table(spark, sf_dir)

    def space(rng: random.Random) -> dict:
        return {**T.boosted_space(rng), "maxIter": rng.randint(2, 5), "maxDepth": rng.randint(2, 4)}

    return T.search(table, f, BOOSTED, space, trials=3).select("trial", "val_pr_auc", "params", "status")


QUERIES = {f.__name__: f for f in (
    train_eval, ordered_rates_model, score_batch, score_explain_trees, drift_classifier, drift_importance, test_like_rows,
    model_round_trip, stream_score_model, perm_importance, leakage_permutation, lag_sensitivity, rate_ablation, seen_unseen_model, cascade, tune)}
ORACLES: dict[str, str] = {
    "model_round_trip": over("tx_events", "select count(*)::bigint as n_scored, count(*)::bigint as n_equal from tx where split = 'test'"),
    "stream_score_model": over("tx_events", "select count(*)::bigint as n_streamed, count(*)::bigint as n_equal from tx where split = 'test'"),
}
