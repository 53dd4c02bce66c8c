"""Watching distributions change, and what to do with scores of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.ordered import running_totals

# Drift grade by ROC-AUC of the train/test classifier (upper bound, grade).
DRIFT_GRADES = ((0.55, "none"), (0.65, "mild"), (0.80, "marked"), (0.95, "severe"))
DRIFT_WORST = "critical"


def drift_grade(auc: Column) -> Column:
    out = F.when(auc < DRIFT_GRADES[0][0], DRIFT_GRADES[0][1])
    for bound, grade in DRIFT_GRADES[1:]:
        out = out.when(auc < bound, grade)
    return out.otherwise(DRIFT_WORST)


def stability_index(df: DataFrame, period: str, expected: str, actual: str,
                    ranges: Sequence[tuple[str, float, float]], bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index of numeric columns between two periods.

    One pass counts (feature, bin) for both periods; empty bins are given the ``floor`` share.
    """
    cols = [
        F.least(F.greatest(F.width_bucket(F.col(c).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)), F.lit(0)), F.lit(bins + 1)).alias(c)
        for c, lo, hi in ranges
    ]
    wide = df.where(F.col(period).isin(expected, actual)).select(F.col(period).alias("_period"), *cols)
    long = wide.unpivot(["_period"], [r[0] for r in ranges], "feature", "bin").where(F.col("bin").isNotNull())
    counts = long.groupBy("feature", "bin").agg(
        F.count_if(F.col("_period") == expected).alias("n_e"), F.count_if(F.col("_period") == actual).alias("n_a")
    )
    totals = counts.groupBy("feature").agg(F.sum("n_e").alias("t_e"), F.sum("n_a").alias("t_a"))
    shares = counts.join(F.broadcast(totals), "feature")  # one row per feature
    p = F.greatest(F.col("n_a") / F.col("t_a"), F.lit(floor))
    q = F.greatest(F.col("n_e") / F.col("t_e"), F.lit(floor))
    return shares.groupBy("feature").agg(F.sum((p - q) * F.ln(p / q)).alias("psi"))


def percent_ranks(df: DataFrame, scores: Sequence[str], row_id: str) -> DataFrame:
    """Percent rank of each score column (ties share the lowest), all columns in one long pass."""
    long = df.select(row_id, *[F.col(s).cast("double").alias(s) for s in scores]).unpivot([row_id], list(scores), "model", "s")
    folded = long.groupBy("model", "s").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(folded, ["s"], {"_upto": "_n"}, by=["model"])
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    below = ranked.select("model", "s", F.col("_upto") - F.col("_n"), total.alias("_t")).toDF("model", "s", "_below", "_t")
    placed = long.join(below, ["model", "s"])
    return placed.withColumn("pct_rank", F.when(F.col("_t") > 1, F.col("_below") / (F.col("_t") - 1)).otherwise(F.lit(0.0)))


def rank_average(df: DataFrame, scores: Sequence[str], row_id: str, name: str = "rank_avg") -> DataFrame:
    """Mean percent rank over the score columns."""
    ranks = percent_ranks(df, scores, row_id).groupBy(row_id).agg(F.avg("pct_rank").alias(name))
    return df.join(ranks, row_id)


def rate_trend(df: DataFrame, ts: str, label: str, group: str, expected: Column, period: str = "day", slack: float = 0.1, alarm: float = 3.0) -> DataFrame:
    """Label rate of each period and group against the rate of the ``expected`` rows, with cumulative-sum statistics.

    ``up`` sums what each period has above the expected number by more than the slack, starting again where
    the sum falls below zero, and ``down`` likewise for too few; both are written as running totals less
    their lowest value so far. An alarm is a sum above ``alarm`` standard deviations of an average period.
    Rows are counted per period and group first; what is ordered has one row for each.
    """
    counted = df.where(F.col(ts).isNotNull() & F.col(label).isNotNull())
    sums = counted.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("missing")).alias("group"), F.date_trunc(period, F.col(ts)).alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("hits"),
        F.count_if(expected).alias("_n"), F.coalesce(F.sum(F.when(expected, F.col(label).cast("bigint"))), F.lit(0)).alias("_hits"),
    )
    whole = Window.partitionBy("group")
    base = F.sum("_hits").over(whole) / F.nullif(F.sum("_n").over(whole), F.lit(0))
    rated = sums.withColumn("expected", base).withColumn("_n_mean", F.avg("n").over(whole))
    so_far = whole.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    own = {
        "_up": F.col("hits") - F.col("n") * F.col("expected") * (1 + slack),
        "_down": F.col("n") * F.col("expected") * (1 - slack) - F.col("hits"),
    }
    totals = rated.withColumns({c: F.sum(v).over(so_far) for c, v in own.items()})
    above = {c[1:]: F.col(c) - F.least(F.min(c).over(so_far), F.lit(0.0)) for c in own}
    limit = F.lit(alarm) * F.sqrt(F.col("_n_mean") * F.col("expected") * (1 - F.col("expected")))
    out = totals.withColumns(above).withColumn("alarm", F.when(F.col("up") > limit, "up").when(F.col("down") > limit, "down"))
    return out.select("group", "period", "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), "expected", "up", "down", "alarm")
