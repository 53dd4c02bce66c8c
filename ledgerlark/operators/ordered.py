"""Row numbers, running totals and exact quantiles over a global order, without a one-task window.

A window with no partition pulls the whole table into one task. Here rows are range-partitioned on
the order columns, sorted inside each partition and pinned; each partition is then one block of the
global order. Per-block totals (one row per block and group) give every block its starting offset.
A unique last order column lets Spark cut even a run of equal leading values into several blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.session import pin

_SEQ, _BLOCK = "_seq", "_block"
# monotonically_increasing_id keeps the partition number in the bits above the lower 33
_POSITION_BITS = 33


def _order_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o).asc() if isinstance(o, str) else o for o in order]


def _blocks(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    cols = _order_columns(order)
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    ranged = ranged.withColumn(_SEQ, F.monotonically_increasing_id())
    return pin(ranged.withColumn(_BLOCK, F.shiftright(_SEQ, _POSITION_BITS)))


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Add the 1-based position of each row in the global order (``order`` must be unique)."""
    blocks = _blocks(df, order)
    # at most one row per range partition
    sizes = blocks.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_offset") + F.col(_SEQ).bitwiseAND((1 << _POSITION_BITS) - 1) + 1
    return (
        blocks.join(F.broadcast(offsets), _BLOCK)
        .withColumn(name, position)
        .drop(_SEQ, _BLOCK, "_offset")
    )


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: Mapping[str, str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums ``{output: input}`` in ``order``, restarting for each ``by`` group."""
    blocks = _blocks(df, [*by, *order])
    totals = blocks.groupBy(_BLOCK, *by).agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    before = Window.partitionBy(*by).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(_BLOCK).alias("_sb"),
        *[F.col(c).alias(f"_s_{c}") for c in by],
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums],
    )
    match = F.col(_BLOCK) == F.col("_sb")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    if not by:
        starts = F.broadcast(starts)  # one row per range partition
    upto = Window.partitionBy(_BLOCK, *by).orderBy(_SEQ).rowsBetween(Window.unboundedPreceding, 0)
    joined = blocks.join(starts, match, "left")
    for out, src in sums.items():
        joined = joined.withColumn(out, F.sum(src).over(upto) + F.col(f"_o_{out}"))
    return joined.drop(_SEQ, _BLOCK, "_sb", *[f"_s_{c}" for c in by], *[f"_o_{out}" for out in sums])


def group_percentiles(df: DataFrame, by: str, value: str, probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation of ``value`` in each group; nulls are left out.

    With ``weight`` a row stands for that many equal rows.

    ``by`` names columns or entities, so groups x probs is a handful of rows. Values are first
    reduced to one row per distinct value and then summed in blocks, so no task holds a whole group
    (the built-in ``percentile`` would).
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n")
    )
    ranked = running_totals(counts, [value], {"_upto": "_n"}, by=[by])
    sizes = ranked.groupBy(by).agg(F.sum("_n").alias("_total"))
    wanted = sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    place = F.col("prob") * (F.col("_total") - 1)
    wanted = wanted.select(
        by, "prob", place.alias("_place"), F.floor(place).alias("_lo"), F.ceil(place).alias("_hi")
    )
    held = ranked.join(F.broadcast(wanted), by).withColumn("_first", F.col("_upto") - F.col("_n"))
    in_lo = (F.col("_first") <= F.col("_lo")) & (F.col("_lo") < F.col("_upto"))
    in_hi = (F.col("_first") <= F.col("_hi")) & (F.col("_hi") < F.col("_upto"))
    picked = (
        held.where(in_lo | in_hi)
        .groupBy(by, "prob", "_place", "_lo")
        .agg(F.max(F.when(in_lo, F.col(value))).alias("_v_lo"), F.max(F.when(in_hi, F.col(value))).alias("_v_hi"))
    )
    weight = F.col("_place") - F.col("_lo")
    between = F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * weight
    return picked.select(by, "prob", between.alias("value"))


#: Every so many rows, by hash, are looked at for the bounds between which an exact quantile is looked for.
BOUND_STEP = 16
#: Rows looked at, and how far around the wanted share the bounds are set for so many (4 standard deviations and the sketch's error).
BOUND_WIDTHS = ((40_000, 0.015), (1_600, 0.055))


def exact_percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of numeric columns: one row per (feature, prob).

    A light pass proposes bounds for each quantile. Then all values are counted, those below the bounds together
    and those between them by value, so only a few hundredths of the values are sorted. A quantile whose place
    turns out not to be between its bounds is taken from all values of its column, as in small tables.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    bounds = _bounds(doubles, columns, probs)
    found = _between(doubles, bounds)
    missed = [c for c in columns if any((c, p) not in found for p in probs)]
    exact = doubles.sparkSession.createDataFrame([(c, float(p), v) for (c, p), v in found.items() if c not in missed], "feature string, prob double, value double")
    if not missed:
        return exact
    long = doubles.select(*missed).unpivot([], missed, "feature", "v")
    rest = group_percentiles(long, "feature", "v", probs)
    return exact.unionByName(rest) if len(missed) < len(columns) else rest


def _bounds(doubles: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], tuple[float, float]]:
    """Two values around each quantile, where there are rows enough to propose them; they need not hold."""
    cuts = [min(max(p + d * w, 0.0), 1.0) for _, w in BOUND_WIDTHS for p in probs for d in (-1, 1)]
    some = doubles.where(F.pmod(F.xxhash64(*columns), F.lit(BOUND_STEP)) == 0)
    seen = some.agg(*[F.struct(F.count(c).alias("n"), F.percentile_approx(c, cuts, 1_000).alias("at")).alias(f"_{i}") for i, c in enumerate(columns)]).first()  # one row
    out = {}
    for i, c in enumerate(columns):
        width = next((j for j, (n, _) in enumerate(BOUND_WIDTHS) if seen[i]["n"] >= n), None)
        if width is not None:
            for k, p in enumerate(probs):
                at = 2 * (width * len(probs) + k)
                out[c, p] = (seen[i]["at"][at], seen[i]["at"][at + 1])
    return out


def _between(doubles: DataFrame, bounds: Mapping[tuple[str, float], tuple[float, float]]) -> dict[tuple[str, float], float]:
    """The quantiles (column, prob) whose places are between their two bounds."""
    if not bounds:
        return {}
    names = list(bounds)
    # an array is exploded where an unpivot of so many columns would make code too long to be compiled
    cells = doubles.select(F.posexplode(F.array(*[F.col(c) for c, _ in names])).alias("_q", "_v")).where(F.col("_v").isNotNull())
    low, high = (F.get(F.lit([float(bounds[name][side]) for name in names]), F.col("_q")) for side in (0, 1))
    # null stands for all values below the bounds, NaN for all above: it is the largest value, and no bound
    place = F.when(F.col("_v") < low, None).when(F.col("_v") <= high, F.col("_v")).otherwise(F.lit(float("nan")))
    counts = cells.groupBy("_q", place.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, [F.col("_v").asc_nulls_first()], {"_upto": "_n"}, by=["_q"])
    sizes = ranked.groupBy("_q").agg(F.sum("_n").alias("_all"))
    p = F.get(F.lit([float(p) for _, p in names]), F.col("_q"))
    # one row per quantile
    wanted = sizes.select("_q", (p * (F.col("_all") - 1)).alias("_place"))
    held = ranked.where(F.col("_v").isNotNull() & ~F.isnan("_v")).join(F.broadcast(wanted), "_q")
    inside = lambda at: (F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto"))
    lo, hi = (F.max(F.when(inside(f(F.col("_place"))), F.col("_v"))) for f in (F.floor, F.ceil))
    picked = held.groupBy("_q", "_place").agg(lo.alias("lo"), hi.alias("hi")).where("lo is not null and hi is not null")
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("_place") - F.floor("_place"))
    return {names[r["_q"]]: r["value"] for r in picked.select("_q", value.alias("value")).collect()}
