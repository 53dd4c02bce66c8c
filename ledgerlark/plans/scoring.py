"""Scoring requests in batch: features, model, bands, and reasons when asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.rows import RowColumns, add_bands, add_row_features, expand_history
from ledgerlark.operators.encoding import apply_top_levels
from ledgerlark.operators.history import TRANSACTION_ENTITIES, Entity, LabelRate, with_label_rates
from ledgerlark.operators.target_statistics import SEEDS
from ledgerlark.plans.levels import CategoryRates
from ledgerlark.plans.training import Features, predict
from ledgerlark.plans.tree_index import TreeIndex, encoded

TOP_REASONS = 5
REASON = "array<struct<feature string, contribution double, direction string>>"


def history_names(entities: Sequence[Entity]) -> list[str]:
    """Output columns of a history spec, in order."""
    out = []
    for e in entities:
        names = ["tx_count_all"] if e.count else []
        names += [f"tx_count_{w}d" for w in e.windows] + [f"distinct_{s}_all" for s, _ in e.distinct]
        names += ["first_seen_days_ago"] if e.age else []
        names += ["is_first_seen"] if e.first_flag else []
        names += ["amount_mean_prev", "amount_std_prev", "amount_max_prev", "amount_ratio_to_mean"] if e.amounts else []
        for r in e.rates:
            names += [f"fraud_rate_smoothed{r.suffix}", f"label_n{r.suffix}"]
        out += [f"{e.name}_{n}" for n in names]
    return out


REQUEST_HISTORY = tuple(history_names(with_label_rates(TRANSACTION_ENTITIES, (LabelRate(),))))


def request_features(requests: DataFrame, prior: float, top_models: DataFrame | None = None,
                     names: Sequence[str] = REQUEST_HISTORY) -> DataFrame:
    """Model columns of score requests: row features, the stored device list, history from the map."""
    out = expand_history(add_row_features(requests, RowColumns()), names, prior)
    return out if top_models is None else apply_top_levels(out, "DeviceModel", top_models)


def _direction(value: Column) -> Column:
    return F.when(value > 0, "increases_risk").otherwise("decreases_risk")


def _top_reasons(reasons: Column, n: int) -> Column:
    """The n entries of array<struct<size, feature, contribution>> with the largest size."""
    best = F.slice(F.sort_array(reasons, asc=False), 1, n)
    return F.transform(
        best,
        lambda r: F.struct(r["feature"].alias("feature"), r["contribution"].alias("contribution"),
                           _direction(r["contribution"]).alias("direction")),
    )


def _vector_names(df: DataFrame, column: str) -> list[str]:
    attrs = df.schema[column].metadata["ml_attr"]["attrs"]
    flat = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [name for _, name in flat]


def linear_reasons(model: PipelineModel, df: DataFrame, n: int = TOP_REASONS, name: str = "reason_codes") -> DataFrame:
    """Coefficient times value for each encoded feature of a linear model."""
    encoded = df
    for stage in model.stages[:-1]:
        encoded = stage.transform(encoded)
    names = _vector_names(encoded, "features")
    weights = [float(w) for w in model.stages[-1].coefficients.toArray()]
    parts = F.zip_with(
        vector_to_array("features"),
        F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(w).alias("w")) for c, w in zip(names, weights)]),
        lambda x, c: F.struct(F.abs(x * c["w"]).alias("size"), c["feature"].alias("feature"), (x * c["w"]).alias("contribution")),
    )
    return encoded.withColumn(name, _top_reasons(parts, n)).select(*df.columns, name)


def slot_groups(model: PipelineModel, f: Features) -> list[list[int]]:
    """Slots of each feature in the vector of a tree model."""
    wide = any(isinstance(stage, CategoryRates) for stage in model.stages)
    out, at = [], 0
    for c in f.names:
        n = len(SEEDS) if wide and c in f.text else 1
        out.append(list(range(at, at + n)))
        at += n
    return out


def occlusion_reasons(model: PipelineModel, df: DataFrame, f: Features, neutral: Mapping[str, object],
                      n: int = TOP_REASONS, name: str = "reason_codes", score: str = "score") -> DataFrame:
    """How much the score of a tree model falls when one feature is set to its usual value, on the row itself."""
    parts = [F.struct(F.lit(c).alias("feature"), (F.col(score) - F.col("_again")[i]).alias("drop")) for i, c in enumerate(f.names)]
    reasons = F.transform(F.array(*parts), lambda p: F.struct(F.abs(p["drop"]).alias("size"), p["feature"].alias("feature"), p["drop"].alias("contribution")))
    return occluded(model, df, f, neutral).withColumn(name, _top_reasons(reasons, n)).drop("_again")


def occluded(model: PipelineModel, df: DataFrame, f: Features, neutral: Mapping[str, object]) -> DataFrame:
    """Add ``_again``: the score of each row with each feature in turn at its usual value."""
    kinds = {c: "double" for c in f.numeric} | {c: "string" for c in f.text}
    usual = df.sparkSession.createDataFrame(
        [tuple(float(neutral[c]) if k == "double" and neutral.get(c) is not None else neutral.get(c) for c, k in kinds.items())],
        ", ".join(f"`{c}` {k}" for c, k in kinds.items()),
    )
    vector = encoded(model, usual).first()["features"].toArray()  # one row
    index = TreeIndex.of(df.sparkSession, model.stages[-1], slot_groups(model, f))
    return encoded(model, df).withColumn("_again", index.rescored("features", neutral=vector)).drop("features")


def score(
    df: DataFrame,
    model: PipelineModel,
    f: Features,
    cutoffs: Mapping[str, float] | None = None,
    model_version: str = "",
    explain: bool = False,
    neutral: Mapping[str, object] | None = None,
) -> DataFrame:
    """The score response of every row."""
    scored = add_bands(predict(model, df), "score", cutoffs)
    if not explain:
        scored = scored.withColumn("reason_codes", F.lit(None).cast(REASON))
    elif hasattr(model.stages[-1], "coefficients"):
        scored = linear_reasons(model, scored)
    else:
        scored = occlusion_reasons(model, scored, f, neutral or {})
    return scored.select(
        f.id, F.col("score").alias("fraud_score"), "risk_band", "is_fraud", "threshold_used", "action",
        F.lit(model_version).alias("model_version"), F.current_timestamp().alias("score_calculated_at"), "reason_codes",
    )


def score_requests(
    requests: DataFrame,
    model: PipelineModel,
    f: Features,
    prior: float,
    top_models: DataFrame | None = None,
    cutoffs: Mapping[str, float] | None = None,
    model_version: str = "",
    explain: bool = False,
    neutral: Mapping[str, object] | None = None,
) -> DataFrame:
    """Score requests as they arrive: transaction columns and a map of history values."""
    featured = request_features(requests, prior, top_models)
    return score(featured, model, f, cutoffs, model_version, explain, neutral)
