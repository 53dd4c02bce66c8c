"""Finding heavy keys and cutting their timeline into pieces a task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.session import pin

# rows of one key that a single window task sorts comfortably
HOT_ROWS = 5_000_000
# longest list of heavy keys that is broadcast
BROADCAST_KEYS = 200_000
# rows of a heavy key in one window group
BLOCK_ROWS = 1_000_000
# timeline slice of a heavy key in the incremental form, microseconds
SLICE_US = 3_600_000_000
# monotonically_increasing_id keeps the partition number in the bits above the lower 33
_POSITION_BITS = 33


def hot_keys(df: DataFrame, key: str, hot_rows: int | None = HOT_ROWS) -> DataFrame | None:
    """Keys with at least ``hot_rows`` rows, flagged, as a pinned table; None when there are none.

    There are at most rows / hot_rows of them, counted before the shuffle. The table is offered for
    broadcast only when its counted size allows; beyond that the join strategy is left to Spark.
    """
    if hot_rows is None:
        return None
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_n"))
    hot = pin(counts.where(F.col("_n") >= hot_rows).select("_hot_key", F.lit(True).alias("_hot")))
    n = hot.count()
    if n == 0:
        return None
    return F.broadcast(hot) if n <= BROADCAST_KEYS else hot


def hot_keys_of(df: DataFrame, keys: Sequence[str], hot_rows: int | None = HOT_ROWS) -> dict[str, DataFrame | None]:
    """``hot_keys`` of several columns from one scan and one shuffle; keys are compared as text."""
    if hot_rows is None or not keys:
        return dict.fromkeys(keys)
    names = list(dict.fromkeys(keys))
    long = df.select(*[F.col(k).cast("string").alias(k) for k in names]).unpivot([], names, "_which", "_hot_key")
    counts = long.where(F.col("_hot_key").isNotNull()).groupBy("_which", "_hot_key").agg(F.count(F.lit(1)).alias("_n"))
    hot = pin(counts.where(F.col("_n") >= hot_rows).select("_which", "_hot_key", F.lit(True).alias("_hot")))
    sizes = {r["_which"]: r["n"] for r in hot.groupBy("_which").agg(F.count(F.lit(1)).alias("n")).collect()}
    out: dict[str, DataFrame | None] = dict.fromkeys(names)
    for k, n in sizes.items():
        own = hot.where(F.col("_which") == k).drop("_which")
        out[k] = F.broadcast(own) if n <= BROADCAST_KEYS else own
    return out


def no_key_can_be_hot(df: DataFrame, hot_rows: int | None) -> bool:
    """True when the whole table is smaller than one hot key would be."""
    return hot_rows is None or df.count() < hot_rows


def mark_hot(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Add ``_hot`` to every row."""
    flagged = df.join(hot, F.col(key).cast(hot.schema["_hot_key"].dataType) == F.col("_hot_key"), "left")
    return flagged.withColumn("_hot", F.coalesce("_hot", F.lit(False))).drop("_hot_key")


def in_pieces(df: DataFrame, key: str, order: Sequence[Column], block_rows: int = BLOCK_ROWS, name: str = "_piece") -> DataFrame:
    """Cut every key into pieces of at most ``block_rows`` rows that follow each other in ``order``, and pin the result.

    Rows are range-partitioned by key and order, so a key of any size, and a run of equal times in it, is
    spread; inside a partition they are counted off. The numbers in ``name`` rise along a key.
    """
    ranged = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", _POSITION_BITS), F.col("_at").bitwiseAND((1 << _POSITION_BITS) - 1)
    piece = F.shiftleft(part, _POSITION_BITS) + F.floor(place / F.lit(block_rows))
    return pin(ranged.withColumn(name, piece.cast("bigint")).drop("_at"))


def slice_of(key: Column, us: Column, row_id: Column, hot: Column | None, width_us: int = SLICE_US) -> Column:
    """The part of a key's rows that goes into one window group.

    Ordinary keys are one slice, heavy keys one slice per ``width_us`` of time, and rows without a
    key are spread by row id because they never look at each other.
    """
    if hot is None:
        return F.when(key.isNull(), F.xxhash64(row_id)).otherwise(F.lit(0).cast("bigint"))
    steps = F.floor(us / F.lit(width_us)).cast("bigint")
    return F.when(key.isNull(), F.xxhash64(row_id)).when(hot, steps).otherwise(F.lit(0).cast("bigint"))
