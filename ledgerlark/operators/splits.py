"""Splits by time and by hash, time folds, samples, and seeded reshuffling of a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.ordered import number_rows


@dataclass(frozen=True)
class TimeSplit:
    """Closed bounds; rows in the gaps belong to no split."""

    train_end: str = "2024-03-31 23:59:59"
    val_start: str = "2024-04-01 00:00:00"
    val_end: str = "2024-05-31 23:59:59"
    test_start: str = "2024-06-01 00:00:00"
    test_end: str = "2024-09-30 23:59:59"


def time_split(df: DataFrame, ts: str, bounds: TimeSplit = TimeSplit(), name: str = "split") -> DataFrame:
    t = F.col(ts)

    def at(text: str) -> Column:
        return F.to_timestamp(F.lit(text))

    part = (
        F.when(t <= at(bounds.train_end), "train")
        .when(t.between(at(bounds.val_start), at(bounds.val_end)), "val")
        .when(t.between(at(bounds.test_start), at(bounds.test_end)), "test")
    )
    return df.withColumn(name, part)


def seeded_hash(row_id: str, seed: int) -> Column:
    """A fixed pseudo-random text per row; the same on every run and in every partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def _below(row_hash: Column, share: float) -> Column:
    return F.substring(row_hash, 1, 8) < F.lit(f"{int(share * 2**32):08x}")


def random_split(df: DataFrame, row_id: str, test: float = 0.2, val: float | None = None, seed: int = 42,
                 name: str = "split") -> DataFrame:
    """Split by hash of the row id: no sort, repeatable, shares hold up to sampling error."""
    val = test / 2 if val is None else val
    h = seeded_hash(row_id, seed)
    return df.withColumn(name, F.when(_below(h, test), "test").when(_below(h, test + val), "val").otherwise("train"))


def stratified_split(df: DataFrame, row_id: str, label: str, test: float = 0.2, val: float = 0.1, seed: int = 42,
                     name: str = "split") -> DataFrame:
    """Exact shares inside each class, by position in the class's seeded-hash order."""
    hashed = df.withColumn("_h", seeded_hash(row_id, seed))
    numbered = number_rows(hashed, [label, "_h", row_id], "_rn")
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n")).orderBy("_class").collect()
    start, part = 0, F.lit("train")
    for row in sizes:  # one row per class
        n_test, n_val = int(row["_n"] * test), int(row["_n"] * val)
        place = F.col("_rn") - start
        inside = F.when(place <= n_test, "test").when(place <= n_test + n_val, "val").otherwise("train")
        part = F.when(F.col(label).eqNullSafe(F.lit(row["_class"])), inside).otherwise(part)
        start += row["_n"]
    return numbered.withColumn(name, part).drop("_h", "_rn")


def split_days(df: DataFrame, ts: str, split: str = "split") -> DataFrame:
    """Whole days covered by each split, at least 1."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    span = F.floor((F.max(us) - F.min(us)) / F.lit(86_400_000_000))
    return df.where(F.col(split).isNotNull()).groupBy(split).agg(F.greatest(F.lit(1), span).cast("bigint").alias("days"))


def time_folds(df: DataFrame, ts: str, row_id: str, shares: Sequence[float] = (0.25, 0.5, 0.75, 1.0),
               name: str = "fold") -> DataFrame:
    """Fold of each row by its position in time; fold 0 is the part that is only trained on."""
    n = df.count()
    numbered = number_rows(df, [ts, row_id], "_rn")
    fold = F.lit(None).cast("int")
    for i in reversed(range(len(shares))):
        fold = F.when(F.col("_rn") <= int(n * shares[i]), i).otherwise(fold)
    return numbered.withColumn(name, fold).drop("_rn")


def seeded_sample(df: DataFrame, row_id: str, n: int = 20_000, seed: int = 0) -> DataFrame:
    """At most ``n`` rows, the same ones on every run."""
    return df.withColumn("_h", seeded_hash(row_id, seed)).orderBy("_h", row_id).limit(n).drop("_h")


def reshuffle(df: DataFrame, columns: Sequence[str], ts: str, row_id: str, seed: int,
              where: Column | None = None) -> DataFrame:
    """Give every row the ``columns`` of another row, one to one, in seeded order.

    With ``where`` only those rows exchange values; the others keep theirs.
    """
    inside = df if where is None else df.where(where)
    rest = None if where is None else df.where(~F.coalesce(where, F.lit(False)))
    takers = number_rows(inside.drop(*columns), [ts, row_id], "_rn")
    hashed = inside.select(row_id, *columns).withColumn("_h", seeded_hash(row_id, seed))
    givers = number_rows(hashed, ["_h", row_id], "_rn").drop("_h", row_id)
    out = takers.join(givers, "_rn").drop("_rn").select(*df.columns)
    return out if rest is None else out.unionByName(rest)


def example_rows(df: DataFrame, label: str, score: str, order: Sequence[str], high: float = 0.8,
                 low: float = 0.2) -> DataFrame:
    """One caught positive, one false alarm and one missed positive, the earliest of each."""
    y, s = F.col(label), F.col(score)
    cases: Mapping[str, Column] = {
        "true_positive": (s > high) & (y == 1),
        "false_positive": (s > high) & (y == 0),
        "missed_positive": (s < low) & (y == 1),
    }
    case = F.lit(None).cast("string")
    for name, hit in cases.items():
        case = F.when(hit, name).otherwise(case)
    whole = F.struct(*[F.col(c) for c in df.columns])
    firsts = df.withColumn("case", case).where(F.col("case").isNotNull())
    firsts = firsts.groupBy("case").agg(F.min_by(whole, F.struct(*order)).alias("_row"))
    return firsts.select("case", "_row.*")
