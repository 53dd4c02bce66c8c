"""Fitting classifiers on the feature table with Spark ML, and measuring them on the later splits."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import encoding
from ledgerlark.operators import target_statistics as ordered
from ledgerlark.operators.history import Entity, LabelRate, Roles, add_history
from ledgerlark.operators.metrics import core_metrics, metrics_table, summary_rows
from ledgerlark.operators.splits import split_days
from ledgerlark.plans.levels import CategoryRates, LevelEncoder, Levels, fit_levels_table
from ledgerlark.session import pin, scratch_folder

# Parameters of the candidate models, and the tuned values of the boosted trees.
LOGREG = {"maxIter": 200, "C": 1.0}
FOREST = {"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 50, "seed": 42}
BOOSTED = {"stepSize": 0.05, "maxIter": 400, "maxDepth": 6, "minInstancesPerNode": 100, "seed": 42}
BOOSTED_TUNED = {"stepSize": 0.04120093878011314, "maxIter": 600, "minInstancesPerNode": 45, "featureSubsetStrategy": "0.6202487355945001"}
BOOSTED_ORDERED = {"stepSize": 0.05, "maxIter": 600, "maxDepth": 8, "seed": 42}
DRIFT = {"stepSize": 0.05, "maxIter": 200, "maxDepth": 5, "minInstancesPerNode": 200, "seed": 42}

#: Rows of a task while trees are boosted; with fewer, a task of one level takes longer to start than to count its rows.
BOOSTED_TASK_ROWS = 20_000
#: Fits that go on together: so many at most, and so many training rows held by all of them (one fit may hold more).
FITS_AT_ONCE, ROWS_AT_ONCE = 4, 8_000_000


@dataclass(frozen=True)
class Features:
    """Feature names and the columns the training needs besides them."""

    numeric: tuple[str, ...]
    text: tuple[str, ...]
    label: str = "label"
    id: str = "tx_id"
    ts: str = "ts"
    split: str = "split"

    @property
    def names(self) -> tuple[str, ...]:
        return self.numeric + self.text

    def without(self, names: Sequence[str]) -> Features:
        return replace(
            self,
            numeric=tuple(c for c in self.numeric if c not in names),
            text=tuple(c for c in self.text if c not in names),
        )


@dataclass(frozen=True)
class Model:
    """A kind of classifier with its parameters."""

    name: str
    kind: str  # logreg, forest, boosted, or ordered (boosted on ordered statistics of the categories)
    params: Mapping[str, object] = field(default_factory=dict)


def standard_models(tuned: Mapping[str, object] | None = None) -> tuple[Model, ...]:
    return (
        Model("logreg", "logreg", LOGREG),
        Model("random_forest", "forest", FOREST),
        Model("hist_gbm", "boosted", {**BOOSTED, **(BOOSTED_TUNED if tuned is None else tuned)}),
        Model("ordered_gbm", "ordered", BOOSTED_ORDERED),
    )


def add_category_rates(df: DataFrame, text: Sequence[str], roles: Roles, prior: float, lag_days: int = 7) -> DataFrame:
    """Lagged label rate of each category: the leak-free target encoding of the ordered model.

    A category may hold most rows of the table; the history operator cuts such keys in time.
    """
    entities = [Entity(f"{c}_level", c, rates=(LabelRate(lag_days),)) for c in text]
    return add_history(df, entities, roles, prior)


# -- fitted encoders -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Fitted:
    """What the encoders learn from the training rows: a value per numeric column, a table of levels."""

    medians: Mapping[str, float]
    levels: Levels | None

    @property
    def neutral(self) -> dict[str, object]:
        """The usual value of every feature."""
        return {**self.medians, **(self.levels.modes if self.levels else {})}


def fit_encoders(train: DataFrame, f: Features) -> Fitted:
    """Medians, modes and levels, once for all models."""
    return Fitted(encoding.fit_fills(train, f.numeric), fit_levels_table(train, f.text) if f.text else None)


def _fill_statement(f: Features, known: Fitted) -> str:
    cols = [f"coalesce(cast(`{c}` as double), {float(known.medians.get(c, 0.0))!r}D) as `{c}__n`" for c in f.numeric]
    return f"select *, {', '.join(cols)} from __THIS__"


def encoding_stages(f: Features, known: Fitted, linear: bool, output: str = "features") -> list:
    """Imputing and encoding up to one vector; the vector of trees has one entry per feature."""
    stages: list = [SQLTransformer(statement=_fill_statement(f, known))] if f.numeric else []
    numeric, indexed = [f"{c}__n" for c in f.numeric], [f"{c}__i" for c in f.text]
    if f.text:
        stages.append(LevelEncoder(f.text, known.levels, linear))
    if linear:
        parts = []
        if numeric:
            stages += [VectorAssembler(inputCols=numeric, outputCol="numeric"),
                       StandardScaler(inputCol="numeric", outputCol="scaled", withMean=False, withStd=True)]
            parts.append("scaled")
        if f.text:
            # the index of unseen values comes last and is dropped: they are all zeros
            hot = [f"{c}__h" for c in f.text]
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True))
            parts += hot
        stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    else:
        stages.append(VectorAssembler(inputCols=numeric + indexed, outputCol=output))
    return stages


def build_pipeline(train: DataFrame, f: Features, model: Model, known: Fitted, weight: str = "weight") -> Pipeline:
    """Imputing, encoding and the classifier as one persistable pipeline."""
    if model.kind == "ordered":
        raise ValueError("an ordered model is fitted on a feature store")
    return Pipeline(stages=[*encoding_stages(f, known, model.kind == "logreg"), classifier(f, model, lambda: train.count(), weight)])


def classifier(f: Features, model: Model, n_train: Callable[[], int], weight: str = "weight"):
    common = {"labelCol": f.label, "featuresCol": "features", "weightCol": weight}
    p = dict(model.params)
    if model.kind == "logreg":
        return LogisticRegression(
            **common, maxIter=int(p["maxIter"]), regParam=1.0 / (float(p["C"]) * max(n_train(), 1)), standardization=False
        )
    if model.kind == "forest":
        # the node that a row has reached in each tree is kept between passes, so no pass walks the trees from their roots
        return RandomForestClassifier(**common, **{"cacheNodeIds": True, **p})
    return GBTClassifier(**common, **p)


def fit(train: DataFrame, f: Features, model: Model, known: Fitted | None = None) -> PipelineModel:
    """Fit with balanced class weights; the encoders are fitted here unless given."""
    slim = train.select(f.label, *f.names)
    known = fit_encoders(slim, f) if known is None else known
    return build_pipeline(slim, f, model, known).fit(encoding.add_class_weight(slim, f.label))


def predict(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Add the probability of the positive class."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


# -- the feature store ----------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureStore:
    """Encoded vectors of all features, written once as Parquet by split, from which every model reads one column.

    ``vectors``: logreg, trees, ordered; a variant is a slice of such a vector. ``stages`` are the fitted
    encoders that lead to each vector, for models that are to score raw rows.
    """

    rows: DataFrame
    f: Features
    known: Fitted
    stages: Mapping[str, list]
    n_train: int

    def slots(self, vector: str, f: Features) -> list[int]:
        """Places of the features of a variant in a vector."""
        sizes = [(c, 1) for c in self.f.numeric]
        if vector == "logreg":
            sizes += [(c, self.known.levels.places[c]) for c in self.f.text]
        else:
            sizes += [(c, len(ordered.SEEDS) if vector == "ordered" else 1) for c in self.f.text]
        out, at, wanted = [], 0, set(f.names)
        for c, n in sizes:
            out += range(at, at + n) if c in wanted else ()
            at += n
        return out


def vector_of(model: Model) -> str:
    return model.kind if model.kind in ("logreg", "ordered") else "trees"


def build_store(table: DataFrame, f: Features, vectors: Sequence[str], known: Fitted | None = None) -> FeatureStore:
    """Encode train, validation and test rows once for all models; class sizes are counted once."""
    is_train = F.col(f.split) == "train"
    slim = table.where(F.col(f.split).isin("train", "val", "test")).select(f.id, f.ts, f.label, f.split, *[c for c in f.names if c not in (f.id, f.ts, f.label)])
    known = fit_encoders(slim.where(is_train), f) if known is None else known
    sizes = {r["class"]: r for r in encoding.class_weights(slim.where(is_train), f.label).collect()}
    n = sum(int(r["n"]) for r in sizes.values())
    weight = F.lit(1.0)
    for value, r in sizes.items():
        weight = F.when(F.col(f.label) == value, float(r["weight"])).otherwise(weight)
    rows, stages = slim.withColumn("weight", weight), {}
    kept = [f.id, f.ts, f.label, f.split, "weight"]
    for v in vectors:
        if v == "ordered":
            names = ordered.statistic_names(f.text)
            prior = float(sum(int(value or 0) * int(r["n"]) for value, r in sizes.items()) / max(n, 1))
            sums = pin(ordered.category_sums(slim.where(is_train), f.text, f.label)) if f.text else None
            own = replace(f, numeric=f.numeric + names, text=())
            filled = Fitted({**known.medians, **dict.fromkeys(names, prior)}, None)
            # training rows get their ordered statistics, the others those that the stage for raw rows gives
            settled = CategoryRates(f.text, sums, prior, sums.count() if sums is not None else 0)
            source = rows
            if f.text:
                early = rows.where(is_train).join(ordered.ordered_statistics(slim.where(is_train), f.text, f.label, f.id, prior), f.id)
                source = early.unionByName(settled.transform(rows.where(~is_train)))
            fitted = Pipeline(stages=encoding_stages(own, filled, False, v)).fit(source).stages
            rows, stages[v] = _only(PipelineModel(fitted).transform(source), [*kept, *f.names], [*stages, v]), [settled, *fitted] if f.text else fitted
        else:
            fitted = Pipeline(stages=encoding_stages(f, known, v == "logreg", v)).fit(rows.where(is_train)).stages
            rows, stages[v] = _only(PipelineModel(fitted).transform(rows), [*kept, *f.names], [*stages, v]), fitted
    path = scratch_folder(table.sparkSession, "features")
    rows.select(*kept, *vectors).write.partitionBy(f.split).parquet(path)
    return FeatureStore(table.sparkSession.read.parquet(path), f, known, stages, n)


def _only(df: DataFrame, columns: Sequence[str], vectors: Sequence[str]) -> DataFrame:
    return df.select(*dict.fromkeys([*columns, *vectors]))


def fit_stored(store: FeatureStore, f: Features, model: Model) -> PipelineModel:
    """Fit on the stored vectors; the result scores stored rows (``predict_stored``)."""
    vector = vector_of(model)
    cut = VectorSlicer(inputCol=vector, outputCol="features", indices=store.slots(vector, f))
    train = store.rows.where(F.col(f.split) == "train").select(f.label, "weight", vector)
    if model.kind in ("boosted", "ordered"):
        train = train.coalesce(max(1, -(-store.n_train // BOOSTED_TASK_ROWS)))
    return Pipeline(stages=[cut, classifier(f, model, lambda: store.n_train)]).fit(train)


def for_raw_rows(store: FeatureStore, fitted: PipelineModel, model: Model) -> PipelineModel:
    """The same model with the encoders in front."""
    return PipelineModel([*store.stages[vector_of(model)], *fitted.stages])


def _levels(model: Model) -> int:
    """Levels of trees that a boosted model grows one after another."""
    return int(model.params.get("maxIter", 20)) * int(model.params.get("maxDepth", 5)) if model.kind in ("boosted", "ordered") else 0


# -- jobs over the feature table --------------------------------------------------------------------


def train_and_evaluate(
    table: DataFrame,
    variants: Mapping[str, Features],
    models: Sequence[Model],
    rule: Callable[[], object] | None = None,
    on_fit: Callable[[str, PipelineModel], None] | None = None,
) -> DataFrame:
    """Every model on every variant, measured on validation and test: the long metrics table.

    Features are encoded and written once; a fit reads one vector of the training rows. Rounds of boosting are
    small jobs one after another, so a few fits go on together. The scores of all models are written once, in
    narrow rows, and measured together.
    """
    any_f = next(iter(variants.values()))
    days = {r[any_f.split]: r["days"] for r in split_days(table, any_f.ts, any_f.split).collect()}
    everything = replace(
        any_f,
        numeric=tuple(dict.fromkeys(c for f in variants.values() for c in f.numeric)),
        text=tuple(dict.fromkeys(c for f in variants.values() for c in f.text)),
    )
    store = build_store(table, everything, tuple(dict.fromkeys(map(vector_of, models))))
    later = store.rows.where(F.col(any_f.split).isin("val", "test"))
    scored: list[DataFrame] = []
    names: list[tuple[str, str]] = []

    def keep(rows: DataFrame, name: str, variant: str, f: Features) -> None:
        names.append((name, variant))
        scored.append(rows.select(
            F.lit(name).alias("model"), F.lit(variant).alias("variant"), F.col(f.split).alias("split"),
            f.id, f.ts, f.label, F.col("score").cast("double").alias("score"),
        ))

    jobs = [(variant, m) for variant in variants for m in models]
    fits: dict[int, PipelineModel] = {}
    with ThreadPoolExecutor(max(1, min(FITS_AT_ONCE, ROWS_AT_ONCE // max(store.n_train, 1)))) as pool:
        longest = sorted(range(len(jobs)), key=lambda i: -_levels(jobs[i][1]))
        started = {pool.submit(fit_stored, store, variants[jobs[i][0]], jobs[i][1]): i for i in longest}
        try:
            for done in as_completed(started):
                variant, m = jobs[started[done]]
                fitted = fits[started[done]] = done.result()
                if on_fit:
                    on_fit(f"{m.name}__{variant}", for_raw_rows(store, fitted, m))
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise
    for variant, f in variants.items():
        if rule is not None:
            keep(table.where(F.col(f.split).isin("val", "test")).withColumn("score", rule()), "rule_based", variant, f)
        for i, (own, m) in enumerate(jobs):
            if own == variant:
                keep(predict(fits[i], later), m.name, variant, f)
    rows = pin(reduce(DataFrame.unionByName, scored))
    per_group = {(n, v, s): d for n, v in names for s, d in days.items()}
    found = summary_rows(rows, any_f.label, "score", (any_f.ts, any_f.id), per_group, ["model", "variant", "split"])
    return metrics_table(table.sparkSession, found)


_LEDGER = "trial int, seed bigint, params string, status string, val_pr_auc double, error string"


def read_trials(spark: SparkSession, ledger: str) -> DataFrame:
    """The trials of a ledger as a table; empty where there is none yet."""
    try:
        return spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").json(ledger)
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], _LEDGER)


def best_parameters(spark: SparkSession, ledger: str) -> dict[str, object] | None:
    """Parameters of the best finished trial (the earliest of equal ones)."""
    best = read_trials(spark, ledger).where("status = 'done'").orderBy(F.col("val_pr_auc").desc(), "seed", "trial").first()
    return json.loads(best["params"]) if best else None


def search(table: DataFrame, f: Features, base: Model, space: Callable[[random.Random], dict], trials: int = 30,
           seed: int = 42, parallel: int = 2, ledger: str | None = None) -> DataFrame:
    """Seeded random search: fit on train, average precision on validation, best first.

    Trials are independent Spark jobs, a few of which run at a time, on one feature store. Each writes its
    row to the ``ledger`` as it ends; a search that is started again goes on with the trials that have not
    ended well under the same seed and parameters.
    """
    rng = random.Random(seed)
    draws = [space(rng) for _ in range(trials)]
    spark = table.sparkSession
    ledger = ledger or scratch_folder(spark, "trials")
    known = {(r["trial"], r["params"]) for r in read_trials(spark, ledger).where((F.col("status") == "done") & (F.col("seed") == seed)).collect()}
    texts = [json.dumps(d, sort_keys=True) for d in draws]
    todo = [i for i, t in enumerate(texts) if (i, t) not in known]
    if todo:
        store = build_store(table, f, (vector_of(base),))
        val = store.rows.where(F.col(f.split) == "val")

        def one(i: int) -> None:
            found, error = None, None
            try:
                fitted = fit_stored(store, f, replace(base, params={**base.params, **draws[i]}))
                got = core_metrics(predict(fitted, val), f.label, "score").first()
                found = float(got["pr_auc"]) if got and got["pr_auc"] is not None else 0.0
            except Exception as problem:  # noqa: BLE001  the ledger keeps it, and the search goes on
                error = str(problem)[:500]
            row = (i, seed, texts[i], "failed" if error else "done", found, error)
            # a folder for each trial, so that trials that end together do not meet
            spark.createDataFrame([row], _LEDGER).coalesce(1).write.mode("overwrite").json(f"{ledger}/seed-{seed}/trial-{i}")

        with ThreadPoolExecutor(parallel) as pool:
            list(pool.map(one, todo))
    rows = read_trials(spark, ledger).where(F.col("seed") == seed)
    return rows.where(F.col("trial") < trials).orderBy(F.col("val_pr_auc").desc_nulls_last(), "trial")


def boosted_space(rng: random.Random) -> dict:
    """Ranges of the search over boosted trees."""
    return {
        "stepSize": 10 ** rng.uniform(-2, -0.7),
        "maxIter": rng.randrange(200, 801, 100),
        "maxDepth": rng.randint(4, 7),
        "minInstancesPerNode": int(round(20 * 25 ** rng.random())),
        "featureSubsetStrategy": f"{rng.uniform(0.5, 1.0):.4f}",
    }
