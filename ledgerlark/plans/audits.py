"""Leakage and drift audits, permutation importance, and the two-stage model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators import overlap, splits
from ledgerlark.operators.drift import drift_grade
from ledgerlark.operators.history import Entity, LabelRate, Roles, add_history, label_prior, with_label_rates
from ledgerlark.operators.metrics import Budget, budget_rows, core_from_curve, core_metrics, score_curve
from ledgerlark.operators.ordered import number_rows
from ledgerlark.plans.scoring import slot_groups
from ledgerlark.plans.training import Features, Model, build_store, fit, fit_stored, predict, vector_of
from ledgerlark.plans.tree_index import TreeIndex, encoded, is_tree_model
from ledgerlark.session import pin

RESULT = "case string, n_features int, pr_auc double, roc_auc double, recall_1pct double, precision_1pct double"


def _parts(table: DataFrame, f: Features) -> tuple[DataFrame, DataFrame]:
    return table.where(F.col(f.split) == "train"), table.where(F.col(f.split) == "test")


def _result(scored: DataFrame, f: Features, case: str) -> tuple:
    curve = pin(score_curve(scored, f.label, "score"))
    core = core_from_curve(curve).first()
    top = budget_rows(scored, f.label, "score", (f.ts, f.id), [Budget("percentile", 0.01)], curve=curve)[0]
    return case, len(f.names), core["pr_auc"], core["roc_auc"], top["recall"], top["precision"]


def _fit_and_test(table: DataFrame, variants: Mapping[str, Features], model: Model) -> list[tuple]:
    """The result of each case. Rows are encoded once for all of them; a case is fitted on a slice of the vectors."""
    f = next(iter(variants.values()))
    everything = replace(
        f,
        numeric=tuple(dict.fromkeys(c for v in variants.values() for c in v.numeric)),
        text=tuple(dict.fromkeys(c for v in variants.values() for c in v.text)),
    )
    store = build_store(table.where(F.col(f.split).isin("train", "test")), everything, (vector_of(model),))
    test = store.rows.where(F.col(f.split) == "test")
    out = []
    for case, v in variants.items():
        # scores are pinned because the curve and the budget both read them
        scored = pin(predict(fit_stored(store, v, model), test).select(f.id, f.ts, f.label, "score"))
        out.append(_result(scored, v, case))
    return out


def lag_sensitivity(base: DataFrame, f: Features, entities: Sequence[Entity], roles: Roles, model: Model,
                    lags: Sequence[int] = (7, 30, 60, 90)) -> DataFrame:
    """The same model with label rates of different lags; all lags come from one pass over the history."""
    rates = [LabelRate(d, suffix=f"_lag{d}") for d in lags]
    rated = [e for e in with_label_rates(entities, rates) if e.rates]
    bare = [Entity(e.name, e.key, rates=e.rates) for e in rated]
    table = pin(add_history(base, bare, roles, label_prior(base, roles.label, "train")))
    variants = {}
    for d in lags:
        mine = tuple(f"{e.name}_{n}_lag{d}" for e in bare for n in ("fraud_rate_smoothed", "label_n"))
        variants[f"lag_{d}d"] = Features(f.numeric + mine, f.text, f.label, f.id, f.ts, f.split)
    return base.sparkSession.createDataFrame(_fit_and_test(table, variants, model), RESULT)


def rate_ablation(table: DataFrame, f: Features, model: Model) -> DataFrame:
    """With and without the label-rate features, and the difference."""
    rate = [c for c in f.names if "fraud_rate" in c or c.endswith("_label_n")]
    a, b = _fit_and_test(table, {"with_rates": f, "without_rates": f.without(rate)}, model)
    delta = ("difference", a[1] - b[1], *[x - y for x, y in zip(a[2:], b[2:])])
    return table.sparkSession.createDataFrame([a, b, delta], RESULT)


def permutation_test(base: DataFrame, f: Features, entities: Sequence[Entity], roles: Roles, model: Model,
                     seed: int = 0) -> DataFrame:
    """Exchange the labels of train and validation, rebuild the label history, fit, and score the real
    test labels: without leakage the average precision falls to the base rate."""
    mixed = splits.reshuffle(base, [roles.label], roles.ts, roles.id, seed, F.col(f.split) != "test")
    rated = [Entity(e.name, e.key, rates=e.rates) for e in entities if e.rates]
    table = pin(add_history(mixed, rated, roles, label_prior(mixed, roles.label, "train")))
    train, test = _parts(table, f)
    scored = pin(predict(fit(train, f, model), test).select(f.id, f.ts, f.label, "score"))
    got = _result(scored, f, "permuted")
    real = table.where(F.col(f.split) == "test").agg(F.avg(f.label)).first()[0]
    rows = [got, ("base_rate", len(f.names), real, 0.5, None, None)]
    return base.sparkSession.createDataFrame(rows, RESULT)


def seen_and_unseen(table: DataFrame, f: Features, model: Model, key: str) -> DataFrame:
    """Test metrics of rows whose key was, and was not, in the training rows."""
    train, test = _parts(table, f)
    scored = predict(fit(train, f, model), test)
    return core_metrics(overlap.mark_seen(scored, train, key), f.label, "score", ["seen"])


# -- drift ---------------------------------------------------------------------------------------


def drift_classifier(table: DataFrame, f: Features, model: Model, seed: int = 42) -> tuple[DataFrame, PipelineModel, DataFrame]:
    """Can a model tell test rows from train rows? (report row, fitted model, held-out rows)."""
    train, test = _parts(table, f)
    both = overlap.stack_with_flag(train, test).withColumn("_held", splits.seeded_hash(f.id, seed) >= F.lit(f"{int(0.8 * 2**32):08x}"))
    df = Features(f.numeric, f.text, "is_test", f.id, f.ts, f.split)
    fitted = fit(both.where(~F.col("_held")), df, model)
    held = both.where("_held").drop("_held")
    auc = core_metrics(predict(fitted, held), "is_test", "score")
    report = auc.select("roc_auc", drift_grade(F.col("roc_auc")).alias("grade"), F.lit(len(f.names)).alias("n_features"), "n")
    return report, fitted, held


def test_like_rows(table: DataFrame, f: Features, fitted: PipelineModel, share: float = 0.2) -> DataFrame:
    """The training rows that look most like test rows, as a validation set for drifting data."""
    train, _ = _parts(table, f)
    scored = pin(predict(fitted, train).select(f.id, f.ts, "score"))
    return _top_share(scored, f, max(1, round(share * scored.count()))).withColumnRenamed("score", "drift_score")


def permutation_importance(model: PipelineModel, rows: DataFrame, f: Features, metric: str = "pr_auc", repeats: int = 3,
                           sample: int | None = None, top: int | None = None, seed: int = 0) -> DataFrame:
    """Mean loss of the metric when one feature is shuffled; of all rows and features unless limited.

    All features share one seeded pairing of rows per repeat. A tree model scores each row for all features that
    its trees test in place (``plans.tree_index``), and only (feature, label, score) go on to the metric; other models score
    a copy of the row for each feature.
    """
    narrow = rows.select(f.id, f.label, *f.names)
    picked = pin(narrow if sample is None else splits.seeded_sample(narrow, f.id, sample, seed))
    base = core_metrics(predict(model, picked), f.label, "score").first()[metric]
    trees = is_tree_model(model)
    kept = pin(encoded(model, picked).select(f.id, f.label, "features")) if trees else picked
    carried = ["features"] if trees else list(f.names)
    takers = number_rows(kept, [f.id], "_rn")
    shuffled = None
    for r in range(repeats):
        given = kept.select(f.id, *carried).withColumn("_h", splits.seeded_hash(f.id, seed + 1 + r))
        donors = number_rows(given, ["_h", f.id], "_rn").select("_rn", *[F.col(c).alias(f"_d_{c}") for c in carried])
        part = takers.join(donors, "_rn").withColumn("_repeat", F.lit(r))
        shuffled = part if shuffled is None else shuffled.unionByName(part)
    names = list(f.names)
    if trees:
        groups = slot_groups(model, f)
        index = TreeIndex.of(rows.sparkSession, model.stages[-1], groups)
        # a feature that no tree tests leaves every score as it is: its loss is 0 and its rows are not made
        at = [i for i, tested in enumerate(index.tested()) if tested]
        names = [f.names[i] for i in at]
        index = replace(index, groups=tuple(tuple(groups[i]) for i in at))
        swapped = shuffled.select("_repeat", f.label, index.rescored("features", vector_to_array("_d_features")).alias("_again"))
        long = swapped.select("_repeat", f.label, F.posexplode("_again").alias("_at", "score"))
        # rows are folded by the number of the feature; its name comes after the fold
        scores = core_metrics(long, f.label, "score", ["_at", "_repeat"])
        scores = scores.withColumn("feature", F.element_at(F.array(*[F.lit(c) for c in names]).cast("array<string>"), F.col("_at") + 1))
    else:
        each = shuffled.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in f.names])))
        scored = predict(model, each.select(
            "feature", "_repeat", f.label,
            *[F.when(F.col("feature") == c, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) for c in f.names],
        ))
        scores = core_metrics(scored, f.label, "score", ["feature", "_repeat"])
    loss = scores.groupBy("feature").agg(F.avg(F.lit(float(base)) - F.col(metric)).alias("importance"))
    if len(names) < len(f.names):
        loss = loss.unionByName(rows.sparkSession.createDataFrame([(c, 0.0) for c in f.names if c not in names], "feature string, importance double"))
    ranked = loss.orderBy(F.col("importance").desc(), "feature")
    return ranked if top is None else ranked.limit(top)


# -- two stages ------------------------------------------------------------------------------------


def out_of_fold(table: DataFrame, f: Features, model: Model, shares: Sequence[float] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Training rows with the score of a model fitted on everything before their fold.

    The first fold has nothing before it and keeps score 0, so it never enters the candidate pool.
    """
    train, _ = _parts(table, f)
    # (time, id) alone is numbered; full rows find their fold by the last place of each
    place = F.struct(f.ts, f.id)
    narrow = splits.time_folds(train.select(f.ts, f.id), f.ts, f.id, shares)
    ends = narrow.agg(*[F.max(F.when(F.col("fold") == i, place)).alias(f"_end{i}") for i in range(len(shares))])  # one row
    fold = F.lit(None).cast("int")
    for i in reversed(range(len(shares))):
        fold = F.when(place <= F.col(f"_end{i}"), i).otherwise(fold)
    folds = pin(train.crossJoin(F.broadcast(ends)).withColumn("fold", fold).drop(*[f"_end{i}" for i in range(len(shares))]))
    out = folds.where("fold = 0").withColumn("score", F.lit(0.0))
    for i in range(1, len(shares)):
        fitted = fit(folds.where(F.col("fold") < i), f, model)
        out = out.unionByName(predict(fitted, folds.where(F.col("fold") == i)))
    return out


def _top_share(df: DataFrame, f: Features, k: int) -> DataFrame:
    """Exactly the k best rows by score, earliest first on ties, without collecting them."""
    placed = number_rows(df.select("score", f.ts, f.id), [F.col("score").desc(), f.ts, f.id], "_place")
    # one row, the last that is in; full rows are compared with it and not sorted
    last = F.broadcast(placed.where(F.col("_place") == k).select(F.col("score").alias("_score"), F.struct(f.ts, f.id).alias("_last")))
    inside = (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.struct(f.ts, f.id) <= F.col("_last")))
    return df.crossJoin(last).where(inside).drop("_score", "_last")


def cascade(table: DataFrame, f: Features, model: Model, share: float = 0.05) -> DataFrame:
    """A second model for the top of the first one's ranking, against the first alone."""
    train, test = _parts(table, f)
    oof = pin(out_of_fold(table, f, model))
    pool = _top_share(oof, f, max(1, int(share * oof.count())))
    second = fit(pool, f, model)
    first = pin(predict(fit(train, f, model), test))
    chosen = _top_share(first, f, int(share * first.count())).drop("score")
    again = predict(second, chosen, "second").select(F.col(f.id).alias("_id"), "second")
    narrow = first.select(f.id, f.ts, f.label, "score")
    both = pin(narrow.join(again, F.col(f.id) == F.col("_id"), "left").drop("_id"))
    single = _result(both, f, "single")
    two = _result(both.withColumn("score", F.coalesce("second", "score")), f, "cascade")
    return table.sparkSession.createDataFrame([single, two], RESULT)


def audit_tables(table: DataFrame, f: Features, entities: Sequence[Entity], roles: Roles, key: str, model: Model,
                 drift_model: Model, lags: Sequence[int] = (7, 30, 60, 90)) -> dict[str, DataFrame]:
    """All audits of a feature table that still holds its key columns, by name."""
    rates = [c for c in table.columns if "fraud_rate" in c or c.endswith("_label_n")]
    base = table.drop(*rates)
    drift, fitted, held = drift_classifier(table, f, drift_model)
    flagged = Features(f.numeric, f.text, "is_test", f.id, f.ts, f.split)
    return {
        "permutation": permutation_test(base, f, with_label_rates(entities), roles, model),
        "lags": lag_sensitivity(base, f.without(rates), entities, roles, model, lags),
        "rate_ablation": rate_ablation(table, f, model),
        "seen_unseen": seen_and_unseen(table, f, model, key),
        "drift": drift,
        "drift_features": permutation_importance(fitted, held, flagged, "roc_auc"),
        "cascade": cascade(table, f, model),
    }
