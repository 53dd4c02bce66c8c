"""Tables fitted on the training rows and then applied everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.ordered import exact_percentiles

TOP_LEVELS = 100
OTHER = "_OTHER_"


def fit_top_levels(train: DataFrame, column: str, n: int = TOP_LEVELS) -> DataFrame:
    """The n most frequent values (missing counts as a value; ties by value)."""
    counts = train.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("level").asc()).limit(n)


def apply_top_levels(df: DataFrame, column: str, levels: DataFrame, other: str = OTHER) -> DataFrame:
    """Values outside the fitted list become ``other``; the list has at most its fitted n rows."""
    top = F.broadcast(levels.select(F.col("level").alias("_level"), F.lit(True).alias("_top")))
    joined = df.join(top, F.col(column).eqNullSafe(F.col("_level")), "left")
    kept = F.when(F.col("_top"), F.col(column)).otherwise(F.lit(other))
    return joined.withColumn(column, kept).drop("_level", "_top")


def fit_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per numeric column."""
    return exact_percentiles(train, columns, [0.5]).select("feature", F.col("value").alias("median"))


def fit_fills(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The exact median of every numeric column, 0 for one without values.

    It fills holes and is the neutral value of a column, so it must not depend on whether there are holes.
    """
    if not columns:
        return {}
    found = {r["feature"]: r["median"] for r in fit_medians(train, columns).collect()}
    return {c: float(found[c]) if found.get(c) is not None else 0.0 for c in columns}


def level_counts(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of each value of each text column, in one scan and one shuffle."""
    texts = train.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "feature", "level").where(F.col("level").isNotNull())
    return long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))


def modes_of(counts: DataFrame) -> DataFrame:
    """Most frequent value of each column, the smallest on ties."""
    best = counts.groupBy("feature").agg(F.min(F.struct(-F.col("n"), F.col("level").alias("v"))).alias("_b"))
    return best.select("feature", F.col("_b.v").alias("mode"))


def fit_modes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per text column, the smallest on ties."""
    return modes_of(level_counts(train, columns))


def fit_levels(train: DataFrame, columns: Sequence[str], min_rows: int = 20) -> DataFrame:
    """Values of each text column with at least ``min_rows`` rows."""
    return level_counts(train, columns).where(F.col("n") >= min_rows)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (2 n_c) for each class."""
    sizes = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over one row per class
    return sizes.select("class", "n", (total / (F.lit(2) * F.col("n"))).alias("weight"))


def add_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights as a column (two class sizes come to the driver)."""
    weights = {r["class"]: float(r["weight"]) for r in class_weights(df, label).collect()}
    out = F.lit(1.0)
    for value, w in weights.items():
        out = F.when(F.col(label) == value, w).otherwise(out)
    return df.withColumn(name, out)


def frequency_encode(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Training-row count of each value as a column; unseen and missing values give 0.

    Columns may have very many values, so the join strategy is left to adaptive execution.
    """
    out = df
    for c in columns:
        counts = train.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(counts, F.col(c) == F.col("_v"), "left")
        out = out.withColumn(f"{c}_freq", F.coalesce("_n", F.lit(0))).drop("_v", "_n")
    return out
