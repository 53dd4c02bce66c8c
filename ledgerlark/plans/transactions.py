"""The whole way from a transactions table to models, reports and scores, with the standard columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.functions.rows import add_row_features, feature_columns, rule_score
from ledgerlark.operators import profile
from ledgerlark.operators.encoding import apply_top_levels, fit_top_levels
from ledgerlark.operators.gate import rejected_counts, set_aside
from ledgerlark.operators.history import TRANSACTION_ENTITIES, LabelRate, Roles, add_history, label_prior, with_label_rates
from ledgerlark.operators.overlap import compare_runs, entity_overlap
from ledgerlark.operators.splits import TimeSplit, time_split
from ledgerlark.plans import reports
from ledgerlark.plans.training import Features, Model, best_parameters, standard_models, train_and_evaluate
from ledgerlark.session import pin
from ledgerlark.sources import transactions as S

ROLES = Roles()
OVERLAP_COLUMNS = ("AccountNumber", "DeviceId", "ReceiverName", "IP_Subnet")
BREAKDOWN_COLUMNS = (
    "TransactionType", "TransactionChannel", "DeviceOSName", "HasMobileActivationL1H", "HasMobileActivationL8H",
    "DayType", "CustomerSegment", "CustomerGender", "IsFractionalAmount",
)


@dataclass(frozen=True)
class FeatureOptions:
    """What goes into the feature table."""

    bounds: TimeSplit = TimeSplit()
    rates: tuple[LabelRate, ...] = (LabelRate(),)
    day_type_variant: str = "unknown"
    # "train" keeps later labels out of the prior; None takes the mean of the whole table
    prior_split: str | None = "train"


def feature_table(tx: DataFrame, options: FeatureOptions = FeatureOptions()) -> tuple[DataFrame, DataFrame, float]:
    """(features with their split, device models kept, prior label rate) of rows that passed the gate.

    History comes first, while rows are narrow, because each entity moves them once; the row features
    are added afterwards in one projection.
    """
    parted = time_split(tx, ROLES.ts, options.bounds)
    prior = label_prior(parted, ROLES.label, options.prior_split)
    entities = with_label_rates(TRANSACTION_ENTITIES, options.rates) if options.rates else TRANSACTION_ENTITIES
    top_models = fit_top_levels(parted.where("split = 'train'"), "DeviceModel")
    rows = add_row_features(add_history(parted, entities, ROLES, prior, gated=True), day_type_variant=options.day_type_variant)
    return apply_top_levels(rows, "DeviceModel", top_models), top_models, prior


def model_features(table: DataFrame, drop_demographic: bool) -> Features:
    num, text = feature_columns(table, {**S.COLUMN_ROLES, "split": "split"}, drop_demographic)
    return Features(tuple(num), tuple(text), ROLES.label, ROLES.id, ROLES.ts)


def profile_tables(tx: DataFrame) -> dict[str, DataFrame]:
    """Everything the profile report shows, by name."""
    columns = [c for c in BREAKDOWN_COLUMNS if c in tx.columns]
    return {
        "schema": S.check_schema(tx),
        "basic": profile.basic_stats(tx, ROLES.label, ROLES.ts),
        "duplicate_rows": profile.duplicate_rows(tx),
        "duplicate_keys": profile.duplicate_keys(tx, ROLES.id),
        "missing": profile.missing_values(tx),
        "cardinality": profile.cardinality(tx),
        "quarterly": profile.rate_by_quarter(tx, ROLES.label, ROLES.ts),
        "breakdown": profile.breakdown(tx, ROLES.label, columns),
        "entities": profile.entity_summary(tx, S.ENTITY_COLUMNS, ROLES.label),
    }


def write_profile(tx: DataFrame, folder: str) -> None:
    for name, table in profile_tables(tx).items():
        S.write_report(table, f"{folder}/{name}")


def train(
    spark: SparkSession,
    data: str,
    folder: str,
    options: FeatureOptions = FeatureOptions(),
    models: Sequence[Model] | None = None,
    trials: str | None = None,
) -> DataFrame:
    """Load, build and write the feature table, fit and measure every model, write models and reports.

    The best parameters of the search whose ledger is ``trials`` take the place of the stored tuned ones.
    Returns the long metrics table as read back from ``folder``.
    """
    tx, rejected = set_aside(S.load_validated(spark, data), ROLES)
    S.write_report(rejected, f"{folder}/rejected", "parquet")
    S.write_report(rejected_counts(spark.read.parquet(f"{folder}/rejected")), f"{folder}/reports/rejected")
    tx = pin(tx)
    table, top_models, prior = feature_table(tx, options)
    S.write_features(table.where("split is not null"), f"{folder}/features")
    S.write_report(top_models.coalesce(1), f"{folder}/top_models")  # at most 100 rows
    table = spark.read.parquet(f"{folder}/features")

    variants = {"full": model_features(table, False), "demographic_free": model_features(table, True)}
    metrics = train_and_evaluate(
        table, variants, standard_models(best_parameters(spark, trials) if trials else None) if models is None else models, rule_score,
        on_fit=lambda name, fitted: S.save_model(fitted, f"{folder}/models/{name}"),
    )
    S.write_report(metrics, f"{folder}/metrics", "parquet")
    metrics = spark.read.parquet(f"{folder}/metrics")
    overlap = entity_overlap(table.where("split = 'train'"), table.where("split = 'test'"), OVERLAP_COLUMNS)
    for name, report in {
        "overlap": overlap,
        "comparison": reports.model_comparison(metrics),
        "ablation": reports.ablation(metrics),
        "thresholds": reports.threshold_table(metrics),
        "recall_by_alerts": reports.recall_by_alerts(metrics),
    }.items():
        S.write_report(report, f"{folder}/reports/{name}")
    best = reports.score_cutoffs(metrics).first()
    cutoffs = {**(best.asDict() if best else {}), "prior": prior}
    S.save_parameters(spark, {k: v for k, v in cutoffs.items() if v is not None}, f"{folder}/cutoffs")
    return metrics


def compare(spark: SparkSession, base: str, improved: str) -> DataFrame:
    """PR-AUC and recall at 1 % of two training runs, side by side."""
    runs = [
        reports.model_comparison(spark.read.parquet(f"{p}/metrics")).select("model", "variant", "pr_auc", "recall_1pct")
        for p in (base, improved)
    ]
    return compare_runs(*runs, ("model", "variant"), ("pr_auc", "recall_1pct")).orderBy("model", "variant")

