"""As-of join: the newest snapshot of a key at or before each row's time.

Only keys, times and ids take part in the search; the rows themselves are moved once, to be joined with
what was found. Keys of ordinary size are searched in one window each. A heavy key is cut into pieces of
bounded rows along its order of time, wherever the border falls, and the last snapshot of each piece is
carried into the following ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators import skew

_UNBOUNDED = Window.unboundedPreceding


def _snapshot_order() -> list[Column]:
    """At equal times snapshots come first, in the order of their values."""
    return [F.col("_us"), F.col("_ask"), F.col("_snap")]


def asof_join(
    rows: DataFrame,
    snapshots: DataFrame,
    key: str,
    ts: str,
    values: Sequence[str],
    row_id: str,
    snapshot_ts: str | None = None,
    hot_rows: int | None = skew.HOT_ROWS,
    block_rows: int = skew.BLOCK_ROWS,
) -> DataFrame:
    """Left as-of join without a range join: both sides share one exchange on the key.

    Of snapshots of a key at one time the one with the largest ``values``, compared from left to right,
    counts; put an id first to choose by it. Rows without a key or time find nothing. ``row_id`` spreads
    the rows when they meet their answers; it may repeat, for rows of one key and time get the same.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    answers = asof_answers(rows, snapshots, key, ts, values, row_id, snapshot_ts, hot_rows, block_rows)
    answers = answers.select(F.col("_id").alias("_a_id"), F.col("_k").alias("_a_k"), F.col("_us").alias("_a_us"), "_found").dropDuplicates(["_a_id", "_a_k", "_a_us"])
    match = F.col(row_id).eqNullSafe(F.col("_a_id")) & F.col(key).eqNullSafe(F.col("_a_k")) & us.eqNullSafe(F.col("_a_us"))
    found = rows.join(answers, match, "left")
    return found.select(*[rows[c] for c in rows.columns], *[F.col("_found")[v].alias(f"asof_{v}") for v in values])


def asof_answers(
    rows: DataFrame,
    snapshots: DataFrame,
    key: str,
    ts: str,
    values: Sequence[str],
    row_id: str,
    snapshot_ts: str | None = None,
    hot_rows: int | None = skew.HOT_ROWS,
    block_rows: int = skew.BLOCK_ROWS,
) -> DataFrame:
    """What ``asof_join`` finds, as _id, _k, _us (time in microseconds) and _found for each row with a key and time."""
    snap_ts = F.col(snapshot_ts or ts).cast("timestamp")
    snaps = snapshots.where(F.col(key).isNotNull() & snap_ts.isNotNull()).select(
        F.col(key).alias("_k"), F.unix_micros(snap_ts).alias("_us"), F.lit(False).alias("_ask"), F.struct(*[F.col(v) for v in values]).alias("_snap"),
    )
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    asks = rows.where(F.col(key).isNotNull() & us.isNotNull()).select(
        F.col(key).alias("_k"), us.alias("_us"), F.col(row_id).alias("_id"), F.lit(True).alias("_ask"),
    )
    both = snaps.unionByName(asks, allowMissingColumns=True)
    keys = both.select("_k")
    hot = None if skew.no_key_can_be_hot(keys, hot_rows) else skew.hot_keys(keys, "_k", hot_rows)
    if hot is None:
        return _in_windows(both)
    marked = skew.mark_hot(both, "_k", hot)
    cold = _in_windows(marked.where(~F.col("_hot")).drop("_hot"))
    return cold.unionByName(_in_pieces(marked.where("_hot").drop("_hot"), block_rows))


def _in_windows(both: DataFrame) -> DataFrame:
    upto = Window.partitionBy("_k").orderBy(*_snapshot_order()).rowsBetween(_UNBOUNDED, 0)
    return both.withColumn("_found", F.last("_snap", ignorenulls=True).over(upto)).where("_ask").select("_id", "_k", "_us", "_found")


def _in_pieces(both: DataFrame, block_rows: int) -> DataFrame:
    """The same for heavy keys: a fill inside each piece, and one carried snapshot per piece."""
    # the id parts the rows of one time
    pieces = skew.in_pieces(both, "_k", [*_snapshot_order(), F.col("_id")], block_rows).repartition("_k", "_piece")
    upto = Window.partitionBy("_k", "_piece").orderBy(*_snapshot_order()).rowsBetween(_UNBOUNDED, 0)
    filled = pieces.withColumn("_inside", F.last("_snap", ignorenulls=True).over(upto))
    latest = pieces.groupBy("_k", "_piece").agg(F.max(F.when(~F.col("_ask"), F.struct("_us", "_snap"))).alias("_latest"))
    before = Window.partitionBy("_k").orderBy("_piece").rowsBetween(_UNBOUNDED, -1)
    carried = latest.select(F.col("_k").alias("_c_k"), F.col("_piece").alias("_c_piece"), F.last("_latest", ignorenulls=True).over(before)["_snap"].alias("_carried"))
    out = filled.where("_ask").join(carried, (F.col("_k") == F.col("_c_k")) & (F.col("_piece") == F.col("_c_piece")), "left")
    return out.select("_id", "_k", "_us", F.coalesce("_inside", "_carried").alias("_found"))
