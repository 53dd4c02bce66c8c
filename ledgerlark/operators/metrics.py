"""Exact ranking metrics over scored rows.

Rows are first folded to one row per distinct score; running counts over those, in blocks, give the
whole curve. Nothing is ever sorted in one task, and ties are treated exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.ordered import running_totals
from ledgerlark.session import pin

# Reported shares of rows, alert budgets per day.
TOP_SHARES = (0.001, 0.005, 0.01, 0.05)
ALERTS_PER_DAY = (50, 100, 350, 1000)


def score_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, best first: n, pos, and both counted down to and with this score."""
    folded = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    return running_totals(folded, [F.col("score").desc()], {"cum_n": "n", "cum_pos": "pos"}, by=by)


def core_from_curve(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half), average precision, base rate, n and positives from a curve."""
    neg = F.col("n") - F.col("pos")
    sums = curve.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("n_positives"),
        F.sum(neg * (F.col("cum_pos") - F.col("pos") / 2)).alias("_above"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("_steps"),
    )
    p, total = F.col("n_positives"), F.col("n")
    both = (p > 0) & (p < total)
    return sums.select(
        *by,
        F.when(both, F.col("_above") / (p * (total - p))).alias("roc_auc"),
        F.when(p > 0, F.col("_steps") / p).alias("pr_auc"),
        (p / total).alias("base_rate"),
        total.cast("bigint").alias("n"),
        p.cast("bigint").alias("n_positives"),
    )


def core_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return core_from_curve(score_curve(df, label, score, by), by)


def at_fixed_thresholds(df: DataFrame, label: str, score: str, thresholds: Sequence[float],
                        by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and derived rates when every score >= threshold is an alert."""
    y, s = F.col(label), F.col(score)
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    # counts for every threshold in one pass; rows are not multiplied
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(y.cast("bigint")).alias("_p")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((s >= t) & (y == 1)).alias(f"_tp{i}"), F.count_if((s >= t) & (y == 0)).alias(f"_fp{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    counts = F.array(*[F.struct(F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp")) for i in range(len(thresholds))])
    rows = wide.select(*by, "_n", "_p", F.explode(F.arrays_zip(cuts.alias("t"), counts.alias("c"))).alias("r"))
    rows = rows.select(*by, F.col("r.t").alias("threshold"), F.col("r.c.tp").alias("tp"), F.col("r.c.fp").alias("fp"), "_n", "_p")
    fn = F.col("_p") - F.col("tp")
    rows = rows.withColumn("fn", fn).withColumn("tn", F.col("_n") - F.col("_p") - F.col("fp"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    def f_beta(beta: float) -> Column:
        b2 = beta * beta
        return ratio((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp"))

    return rows.select(
        *by, "threshold", "tn", "fp", "fn", "tp",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("_p")).alias("recall"),
        f_beta(1).alias("f1"),
        f_beta(2).alias("f2"),
    )


@dataclass(frozen=True)
class Budget:
    """How many alerts to raise: a share of all rows, or a number per day."""

    perspective: str
    k: float

    def alerts(self, n: int, days: int) -> int:
        share = self.k
        if self.perspective == "alerts_per_day":
            share = min(n, max(1, int(self.k) * days)) / n
        return max(1, round(n * share))  # round() is half-even


def standard_budgets(with_days: bool = True, shares: Sequence[float] = TOP_SHARES,
                     per_day: Sequence[int] = ALERTS_PER_DAY) -> list[Budget]:
    out = [Budget("percentile", f) for f in shares]
    return out + [Budget("alerts_per_day", float(a)) for a in per_day] if with_days else out


BUDGET_SCHEMA = (
    "perspective string, k double, n_alerts bigint, threshold double, precision double, recall double, "
    "tp bigint, fp bigint, fn bigint, fraud_capture_pct double"
)


def budget_rows(df: DataFrame, label: str, score: str, order: Sequence[str], budgets: Sequence[Budget],
                days: int | Mapping[tuple, int] = 1, by: Sequence[str] = (), curve: DataFrame | None = None) -> list[dict]:
    """Metrics of each budget as plain records: the top k rows by score, ties by ``order``.

    ``by`` splits the rows into a few groups (models, splits), each with its own k; ``days`` may then
    be given per group. Only one boundary per group and budget comes to the driver. A budget that
    ends inside a run of equal scores numbers the rows of that run in ``order`` to see how many
    positives fall inside. Without a ``curve`` the few columns needed are written once first, so that
    whatever made the scores runs once. A null score has no rank and is refused.
    """
    by = list(by)
    if curve is None:
        df = pin(df.select(*dict.fromkeys([*by, score, label, *order])))
        curve = pin(score_curve(df, label, score, by))
    unscored = curve.where(F.col("score").isNull()).agg(F.sum("n")).first()[0]
    if unscored:
        raise ValueError(f"{unscored} rows have no score")
    totals = curve.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p")).collect()
    groups = {tuple(r[c] for c in by): (int(r["_n"]), int(r["_p"])) for r in totals if r["_n"]}
    if not groups:
        return []

    def is_group(g: tuple) -> Column:
        hit = F.lit(True)
        for c, v in zip(by, g):
            hit = hit & F.col(c).eqNullSafe(F.lit(v))
        return hit

    ks: dict[tuple, list[int]] = {}
    for g, (n, _) in groups.items():
        span = days if isinstance(days, int) else days.get(g, 1)
        ks[g] = [b.alerts(n, span) for b in budgets]
    point = F.struct("cum_n", "score", "n", "pos", "cum_pos")
    firsts = []
    for i in range(len(budgets)):
        k = F.lit(None).cast("bigint")
        for g in groups:
            k = F.when(is_group(g), ks[g][i]).otherwise(k)
        firsts.append(F.min(F.when(F.col("cum_n") >= k, point)).alias(f"e{i}"))
    ends = {tuple(r[c] for c in by): r for r in curve.groupBy(*by).agg(*firsts).collect()}

    caught: dict[tuple, int] = {}
    cut: list[tuple] = []
    for g in groups:
        for i, k in enumerate(ks[g]):
            end = ends[g][f"e{i}"]
            if end["cum_n"] == k:
                caught[g, i] = end["cum_pos"]
            else:
                cut.append((g, i))
    if cut:
        in_run = F.lit(False)
        for g, s in {(g, float(ends[g][f"e{i}"]["score"])) for g, i in cut}:
            in_run = in_run | (is_group(g) & (F.col(score) == s))
        tied = df.where(in_run).select(
            *by, F.col(score).alias("_score"), F.col(label).cast("bigint").alias("_y"), *order, F.lit(1).alias("_one")
        )
        placed = running_totals(tied, list(order), {"_place": "_one"}, by=[*by, "_score"])
        taken = []
        for g, i in cut:
            end = ends[g][f"e{i}"]
            room = ks[g][i] - (end["cum_n"] - end["n"])
            hit = is_group(g) & (F.col("_score") == float(end["score"])) & (F.col("_place") <= room)
            taken.append(F.sum(F.when(hit, F.col("_y"))))
        got = placed.agg(*taken).first()
        for j, (g, i) in enumerate(cut):
            end = ends[g][f"e{i}"]
            caught[g, i] = end["cum_pos"] - end["pos"] + int(got[j] or 0)

    out = []
    for g, (_, positives) in groups.items():
        for i, b in enumerate(budgets):
            k, tp = ks[g][i], int(caught[g, i])
            recall = tp / max(positives, 1)
            out.append(
                dict(zip(by, g), perspective=b.perspective, k=float(b.k), n_alerts=k,
                     threshold=float(ends[g][f"e{i}"]["score"]), precision=tp / k, recall=recall,
                     tp=tp, fp=k - tp, fn=positives - tp, fraud_capture_pct=recall * 100)
            )
    return out


def at_budgets(df: DataFrame, label: str, score: str, order: Sequence[str], budgets: Sequence[Budget],
               days: int | Mapping[tuple, int] = 1, by: Sequence[str] = ()) -> DataFrame:
    """``budget_rows`` as a table."""
    rows = budget_rows(df, label, score, order, budgets, days, by)
    names = [*by, *[p.split()[0] for p in BUDGET_SCHEMA.split(", ")]]
    schema = ", ".join([*[f"{c} string" for c in by], BUDGET_SCHEMA])
    return df.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def top_rows(df: DataFrame, score: str, k: int, order: Sequence[str]) -> DataFrame:
    """The k best rows, ties by ``order``, for report-sized k."""
    return df.orderBy(F.col(score).desc(), *order).limit(k)


METRIC_SCHEMA = (
    "model string, variant string, split string, perspective string, k double, n_alerts bigint, "
    "threshold double, precision double, recall double, roc_auc double, pr_auc double, base_rate double, "
    "n bigint, n_positives bigint"
)


def summary_rows(df: DataFrame, label: str, score: str, order: Sequence[str], days: int | Mapping[tuple, int],
                 by: Sequence[str] = (), **tags: str) -> list[dict]:
    """The core row and one row per standard budget of each group, for the long metrics table."""
    curve = pin(score_curve(df, label, score, by))  # read by three small jobs
    rows = [{**tags, "perspective": "core", **r.asDict()} for r in core_from_curve(curve, by).collect()]
    wanted = (*by, "perspective", "k", "n_alerts", "threshold", "precision", "recall")
    for r in budget_rows(df, label, score, order, standard_budgets(), days, by, curve):
        rows.append({**tags, **{c: r[c] for c in wanted}})
    return rows


def metrics_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    names = [p.split()[0] for p in METRIC_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], METRIC_SCHEMA)


# -- cost and precision driven cut-offs ------------------------------------------------------------


def threshold_for_precision(curve: DataFrame, min_precision: float) -> DataFrame:
    """The lowest cut-off whose alerts still have ``min_precision``, with its precision and recall."""
    total = curve.agg(F.sum("pos").alias("_p"))
    ok = F.col("cum_pos") / F.col("cum_n") >= F.lit(min_precision)
    best = curve.agg(F.max(F.when(ok, F.struct("cum_n", "score", "cum_pos"))).alias("b"))
    p = total.scalar()
    return best.select(
        F.col("b.score").alias("threshold"),
        F.col("b.cum_n").alias("n_alerts"),
        (F.col("b.cum_pos") / F.col("b.cum_n")).alias("precision"),
        (F.col("b.cum_pos") / p).alias("recall"),
    )


def threshold_for_cost(curve: DataFrame, cost_fp: float, cost_fn: float) -> DataFrame:
    """The cut-off with the least total cost of false alarms and misses (ties: fewer alerts)."""
    p = curve.agg(F.sum("pos").alias("_p")).scalar()
    cost = F.lit(float(cost_fp)) * (F.col("cum_n") - F.col("cum_pos")) + F.lit(float(cost_fn)) * (p - F.col("cum_pos"))
    best = curve.agg(F.min(F.struct(cost.alias("cost"), F.col("cum_n"), F.col("score"))).alias("b"))
    return best.select(
        F.col("b.score").alias("threshold"), F.col("b.cum_n").alias("n_alerts"), F.col("b.cost").alias("cost")
    )
