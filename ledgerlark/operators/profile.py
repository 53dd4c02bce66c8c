"""Profiling a table: sizes, missing values, distinct counts, rates by group, entity summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.operators.ordered import exact_percentiles, group_percentiles
from ledgerlark.session import pin

DAY_US = 86_400_000_000


def basic_stats(df: DataFrame, label: str, ts: str) -> DataFrame:
    """Rows, columns, positives, rate, 1:x imbalance, first and last time, span in whole days."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rate = F.avg(label)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        F.sum(F.col(label).cast("bigint")).alias("n_positives"),
        F.round(rate, 6).alias("positive_rate"),
        F.when(rate > 0, F.rint(1 / rate)).cast("bigint").alias("imbalance_1_to"),
        F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss").alias("date_min"),
        F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss").alias("date_max"),
        F.floor((F.max(us) - F.min(us)) / F.lit(DAY_US)).cast("bigint").alias("span_days"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each fully equal set.

    Only 8-byte row hashes are grouped for the whole table; full rows are compared just where a hash
    repeats, so the result is exact and the wide rows are not shuffled.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns))
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    suspects = hashed.join(again, "_hash", "left_semi").drop("_hash")
    sets = suspects.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return sets.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates_full_row"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates_key"))


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percent of every column that has any, in one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = wide.unpivot(["_n"], list(df.columns), "column", "n_missing").where(F.col("n_missing") > 0)
    return long.select("column", "n_missing", F.round(F.col("n_missing") / F.col("_n") * 100, 4).alias("pct"))


def _texts(df: DataFrame, columns: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    return df.select(*extra, *[F.col(c).cast("string").alias(c) for c in columns])


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column; exact through two grouped steps over (column, value)."""
    columns = list(columns or df.columns)
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return wide.unpivot([], columns, "column", "n_distinct")
    values = _texts(df, columns).unpivot([], columns, "column", "value")
    pairs = values.groupBy("column", "value").agg(F.lit(1).alias("_one"))
    return pairs.groupBy("column").agg(F.count("value").alias("n_distinct"))


def top_cardinality(df: DataFrame, n: int = 15) -> DataFrame:
    return cardinality(df).orderBy(F.col("n_distinct").desc(), "column").limit(n)


def type_composition(df: DataFrame) -> DataFrame:
    """Number of columns of each type."""
    counts: dict[str, int] = {}
    for _, name in df.dtypes:
        counts[name] = counts.get(name, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "type string, n_columns bigint")


def breakdown(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Rows, positives and rate for each value of each column; a missing value is a group.

    One scan and one shuffle for all columns; every value is folded before the shuffle.
    """
    y = F.col(label).cast("bigint").alias("_y")
    long = _texts(df, columns, [y]).unpivot(["_y"], list(columns), "column", "value")
    sums = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n_positives"))
    return sums.withColumn("rate_pct", F.round(F.col("n_positives") / F.col("n") * 100, 4))


def lift_table(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Breakdown with the rate to 3 places and its ratio to the overall rate."""
    overall = df.agg(F.avg(label).alias("_rate")).scalar()
    rate = F.round(F.col("n_positives") / F.col("n") * 100, 3)
    out = breakdown(df, label, columns).withColumn("rate_pct", rate)
    return out.withColumn("lift", F.round(F.col("rate_pct") / (overall * 100), 2))


def rate_by(df: DataFrame, label: str, group: Column, name: str) -> DataFrame:
    sums = df.groupBy(group.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("n_positives"))
    return sums.withColumn("rate_pct", F.round(F.col("n_positives") / F.col("n") * 100, 4))


def rate_by_quarter(df: DataFrame, label: str, ts: str) -> DataFrame:
    return rate_by(df, label, F.concat(F.year(ts), F.lit("Q"), F.quarter(ts)), "quarter")


def rate_by_month(df: DataFrame, label: str, ts: str) -> DataFrame:
    return rate_by(df, label, F.date_format(ts, "yyyy-MM"), "month")


def rate_by_hour(df: DataFrame, label: str, ts: str) -> DataFrame:
    return rate_by(df, label, F.hour(ts).cast("bigint"), "hour")


def rate_by_weekday(df: DataFrame, label: str, ts: str) -> DataFrame:
    return rate_by(df, label, F.weekday(ts).cast("bigint"), "dow")


def _per_key(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    y = F.col(label).cast("bigint").alias("_y")
    long = _texts(df, columns, [y]).unpivot(["_y"], list(columns), "entity", "key").where(F.col("key").isNotNull())
    return long.groupBy("entity", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))


def entity_summary(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Keys, rows per key (mean, quantiles, max), keys with a positive, keys with only positives.

    Keys are folded to one row per (entity, rows per key), which is small and serves every figure.
    """
    sizes = pin(
        _per_key(df, columns, label).groupBy("entity", "n").agg(
            F.count(F.lit(1)).alias("keys"),
            F.count_if(F.col("pos") > 0).alias("some"),
            F.count_if(F.col("pos") == F.col("n")).alias("only"),
        )
    )
    sums = sizes.groupBy("entity").agg(
        F.sum("keys").alias("n_keys"),
        F.round(F.sum(F.col("n") * F.col("keys")) / F.sum("keys"), 3).alias("rows_mean"),
        F.max("n").alias("rows_max"),
        F.sum("some").alias("keys_with_positive"),
        F.sum("only").alias("keys_only_positive"),
    )
    probs = {"rows_p50": 0.5, "rows_p90": 0.9, "rows_p99": 0.99}
    long = group_percentiles(sizes, "entity", "n", list(probs.values()), weight="keys")
    wide = long.groupBy("entity").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in probs.items()])
    return sums.join(wide, "entity")


def key_histogram(df: DataFrame, key: str, clip: int = 10) -> DataFrame:
    """How many keys have 1, 2, … rows; the last bar collects the rest."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(F.least("_n", F.lit(clip)).alias("rows_per_key")).agg(F.count(F.lit(1)).alias("n_keys"))


def _partners(df: DataFrame, key: str, partner: str) -> DataFrame:
    pairs = df.where(F.col(key).isNotNull()).groupBy(key, partner).agg(F.lit(1).alias("_one"))
    return pairs.groupBy(key).agg(F.count(partner).alias("partners"))


def partner_counts(df: DataFrame, key: str, partner: str, at_least: Sequence[int] = (3, 10)) -> DataFrame:
    """Keys, and keys with at least so many distinct partners."""
    return _partners(df, key, partner).agg(
        F.count(F.lit(1)).alias("n_keys"),
        *[F.count_if(F.col("partners") >= k).alias(f"keys_ge_{k}") for k in at_least],
    )


def partner_histogram(df: DataFrame, key: str, partner: str, clip: int = 50) -> DataFrame:
    bars = F.least("partners", F.lit(clip)).alias("partners")
    return _partners(df, key, partner).groupBy(bars).agg(F.count(F.lit(1)).alias("n_keys"))


def risky_keys(df: DataFrame, key: str, label: str, min_rows: int = 10, min_rate: float = 0.5) -> DataFrame:
    """Keys whose rows are all positive; keys with enough rows and a high rate."""
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"))
    return keys.agg(
        F.count_if(F.col("rate") == 1).alias("keys_all_positive"),
        F.count_if((F.col("n") >= min_rows) & (F.col("rate") >= min_rate)).alias("keys_high_rate"),
    )


def describe_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, max and exact quantiles of numeric columns."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], list(columns), "feature", "v")
    sums = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.max("v").alias("max"))
    probs = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    quantiles = exact_percentiles(df, columns, list(probs.values()))
    wide = quantiles.groupBy("feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in probs.items()]
    )
    return sums.join(wide, "feature")


def class_histogram(df: DataFrame, label: str, ranges: Sequence[tuple[str, Column, float, float]], bins: int = 20) -> DataFrame:
    """Rows per class and bin for each (name, expression, low, high); bin 0 and bins + 1 lie outside."""
    cols = [F.width_bucket(v, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).alias(name) for name, v, lo, hi in ranges]
    wide = df.select(F.col(label).alias("class"), *cols)
    long = wide.unpivot(["class"], [r[0] for r in ranges], "feature", "bin")
    return long.groupBy("feature", "class", "bin").agg(F.count(F.lit(1)).alias("n"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def naive_accuracy(df: DataFrame, label: str) -> DataFrame:
    """Accuracy of always answering no."""
    return df.agg((1 - F.avg(label)).alias("naive_accuracy"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
