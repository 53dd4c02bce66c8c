"""The event form of history: a row arrives, leaves each window, and its label becomes known.

Every statistic of a row is a sum over strictly earlier events of its key. Sums can be cut anywhere
in time: windows run inside a slice, and the totals of all earlier slices are carried in. The same
totals, kept between runs, make the computation incremental.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators import skew
from ledgerlark.operators.history_spec import DAY_US, Entity, Roles

_UNBOUNDED = Window.unboundedPreceding
ARRIVE = "arrive"
# slice number of totals kept from an earlier run: before every real slice
SEED_SLICE = -(1 << 62)
EVENT = ("_e_key", "_e_kind", "_e_us", "_e_id", "_e_label", "_e_amount")


def event_delays(e: Entity) -> dict[str, int]:
    """Event name -> delay in microseconds after the row."""
    kinds = {ARRIVE: 0}
    kinds.update({f"out_{w}": w * DAY_US for w in e.windows})
    for i, r in enumerate(e.rates):
        kinds[f"known_{i}"] = r.lag_days * DAY_US
        if r.window_days is not None:
            kinds[f"gone_{i}"] = (r.lag_days + r.window_days) * DAY_US
    return kinds


def add_slices(events: DataFrame, hot: DataFrame | None, width: int) -> DataFrame:
    """Add ``_hot`` and ``_e_slice``."""
    marked = events.withColumn("_hot", F.lit(False)) if hot is None else skew.mark_hot(events, "_e_key", hot)
    flag = None if hot is None else F.col("_hot")
    return marked.withColumn("_e_slice", skew.slice_of(F.col("_e_key"), F.col("_e_us"), F.col("_e_id"), flag, width))


def events_of(df: DataFrame, e: Entity, roles: Roles, keep: Sequence[str] = ()) -> DataFrame:
    """One row per event; arrivals carry the ``keep`` columns in one struct, so other events stay narrow."""
    has_key = F.col(e.key).isNotNull()
    stamps = [
        F.struct(F.lit(kind).alias("kind"), (F.col("_us") + F.lit(delay)).alias("at"))
        for kind, delay in event_delays(e).items()
    ]
    event = F.explode(F.when(has_key, F.array(*stamps)).otherwise(F.array(stamps[0])))
    arrival = F.col("_event.kind") == ARRIVE
    cols = [
        F.col(e.key).alias("_e_key"),
        F.col("_event.kind").alias("_e_kind"),
        F.col("_event.at").alias("_e_us"),
        F.col(roles.id).alias("_e_id"),
        (F.col(roles.label) if e.rates else F.lit(0)).cast("bigint").alias("_e_label"),
        (F.col(roles.amount) if e.amounts else F.lit(0.0)).cast("double").alias("_e_amount"),
    ]
    if keep:
        cols.append(F.when(arrival, F.struct(*[F.col(c) for c in keep])).alias("_row"))
    return df.withColumn("_event", event).select(*cols)


def first_meetings(base: DataFrame, e: Entity, roles: Roles, suffix: str, target: str) -> DataFrame:
    """The first row of each (key, target); hot pairs are folded before the shuffle."""
    known = base.where(F.col(e.key).isNotNull())
    first = known.groupBy(F.col(e.key).alias("_e_key"), F.col(target).alias("_target")).agg(
        F.min(F.struct(F.col("_us"), F.col(roles.id).alias("id"))).alias("_f")
    )
    return first.select(
        "_e_key", "_target", F.lit(f"met_{suffix}").alias("_e_kind"), F.col("_f._us").alias("_e_us"), F.col("_f.id").alias("_e_id")
    )


def _tallies(e: Entity) -> dict[str, Column]:
    """Additive measures of an event row; their sums over earlier events are the statistics."""

    def one(kind: str) -> Column:
        return (F.col("_e_kind") == kind).cast("bigint")

    def hit(kind: str) -> Column:
        return F.when(F.col("_e_kind") == kind, F.col("_e_label")).otherwise(F.lit(0))

    out = {"n": one(ARRIVE)}
    out.update({f"out_{w}": one(f"out_{w}") for w in e.windows})
    out.update({f"distinct_{s}": one(f"met_{s}") for s, _ in e.distinct})
    for i, r in enumerate(e.rates):
        out[f"known_{i}"], out[f"hits_{i}"] = one(f"known_{i}"), hit(f"known_{i}")
        if r.window_days is not None:
            out[f"known_{i}"] = out[f"known_{i}"] - one(f"gone_{i}")
            out[f"hits_{i}"] = out[f"hits_{i}"] - hit(f"gone_{i}")
    return out


def slice_totals(events: DataFrame, e: Entity, also: Sequence[Column] = ()) -> DataFrame:
    """Sums, extremes and the spread of amounts for each (key, slice), and what else is asked for."""
    arrived = F.col("_e_kind") == ARRIVE
    amount, us = F.when(arrived, F.col("_e_amount")), F.when(arrived, F.col("_e_us"))
    return events.groupBy("_e_key", "_e_slice").agg(
        *[F.sum(c).alias(f"s_{name}") for name, c in _tallies(e).items()],
        F.min(us).alias("s_first"),
        F.max(us).alias("s_last"),
        F.max(amount).alias("s_max"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("s_sum"),
        F.coalesce(F.var_pop(amount) * F.count(amount), F.lit(0.0)).alias("s_spread"),
        *also,
    )


def _centred(per_slice: DataFrame) -> DataFrame:
    """Add the distance of each slice's mean amount from the mean of the key, so squares stay small."""
    whole = Window.partitionBy("_e_key")
    centre = F.sum("s_sum").over(whole) / F.nullif(F.sum("s_n").over(whole), F.lit(0))
    off = F.when(F.col("s_n") > 0, F.col("s_sum") / F.col("s_n") - F.col("_centre")).otherwise(F.lit(0.0))
    return per_slice.withColumn("_centre", centre).withColumn("_off", off)


def carry_in(per_slice: DataFrame, e: Entity, strict: bool = False) -> DataFrame:
    """Totals of all earlier slices for each slice of a key (a key has span / width slices at most).

    With ``strict`` also those of the earlier events that are strictly older than the slice's first time, from
    its first and last time and the sums over its events at the last one (``t_``).
    """
    earlier = Window.partitionBy("_e_key").orderBy("_e_slice").rowsBetween(_UNBOUNDED, -1)
    centred = _centred(per_slice)

    def total(c: Column | str) -> Column:
        return F.sum(c).over(earlier)

    n = total("s_n")
    spread = total(F.col("s_spread") + F.col("s_n") * F.col("_off") * F.col("_off"))
    shift = total(F.col("s_n") * F.col("_off"))
    if strict:
        centred = _with_runs(centred, e)
    return centred.select(
        F.col("_e_key").alias("_c_key"),
        F.col("_e_slice").alias("_c_slice"),
        *[total(f"s_{name}").alias(f"_c_{name}") for name in _tallies(e)],
        F.min("s_first").over(earlier).alias("_c_first"),
        F.max("s_last").over(earlier).alias("_c_last"),
        F.max("s_max").over(earlier).alias("_c_max"),
        total("s_sum").alias("_c_sum"),
        F.when(n > 0, spread - shift * shift / n).alias("_c_spread"),
        *(_strict_totals(e) if strict else ()),
    )


def carry_over(totals: DataFrame, e: Entity) -> DataFrame:
    """``merge_totals`` of earlier runs as what is carried into the one slice of a key."""
    return totals.select(
        F.col("_e_key").alias("_c_key"),
        F.lit(0).cast("bigint").alias("_c_slice"),
        *[F.col(f"s_{name}").alias(f"_c_{name}") for name in (*_tallies(e), "first", "last", "max", "sum")],
        F.when(F.col("s_n") > 0, F.col("s_spread")).alias("_c_spread"),
    )


def merge_totals(per_slice: DataFrame, e: Entity) -> DataFrame:
    """All slices of a key as one row, in the form of ``slice_totals``."""
    return _centred(per_slice).groupBy("_e_key").agg(
        F.lit(SEED_SLICE).alias("_e_slice"),
        *[F.sum(f"s_{name}").alias(f"s_{name}") for name in _tallies(e)],
        F.min("s_first").alias("s_first"),
        F.max("s_last").alias("s_last"),
        F.max("s_max").alias("s_max"),
        F.sum("s_sum").alias("s_sum"),
        F.sum(F.col("s_spread") + F.col("s_n") * F.col("_off") * F.col("_off")).alias("s_spread"),
    )


def _with_runs(pieces: DataFrame, e: Entity) -> DataFrame:
    """Add ``_run_``: sums at the last time of a piece, over it and the pieces before that end at the same time.

    A run of equal times may span pieces: the earlier ones end at that time and the sums over their last
    time are its part there, so the run up to a border is a running sum over pieces that end at one time.
    """
    upto = Window.partitionBy("_e_key", "_last").orderBy("_e_slice").rowsBetween(_UNBOUNDED, 0)
    return pieces.withColumns({f"_run_{n}": F.sum(f"t_{n}").over(upto) for n in timed_tallies(e)})


def _strict_totals(e: Entity) -> list[Column]:
    """The first time of a piece, and the totals of all earlier events that are strictly older than that."""
    order = Window.partitionBy("_e_key").orderBy("_e_slice")
    earlier = order.rowsBetween(_UNBOUNDED, -1)
    goes_on = F.lag("_last").over(order) == F.col("_begin")
    return [
        F.col("_begin").alias("_c_begin"),
        *[(F.sum(f"s_{n}").over(earlier) - F.when(goes_on, F.lag(f"_run_{n}").over(order)).otherwise(F.lit(0))).alias(f"_s_{n}") for n in timed_tallies(e)],
    ]


def timed_tallies(e: Entity) -> list[str]:
    """Tallies that go by time alone; ``n`` is among them for the rolling counts."""
    return ["n", *[name for name in _tallies(e) if name != "n" and not name.startswith("distinct_")]]


def statistics_over(events: DataFrame, carry: DataFrame, e: Entity, keep: Sequence[str] | None) -> DataFrame:
    """Raw statistics of the arrivals: sums inside the slice plus what is carried in.

    With ``keep`` the arrivals' own rows come out of their struct; without, key, time and id stand for them.
    Where the carry knows strictly older totals (``_s_``), rows at the first time of a slice use those.
    """
    group = ["_e_key", "_e_slice"]
    arrived = F.col("_e_kind") == ARRIVE
    # at equal (time, id) the arrival comes first, so a row never meets its own target
    by_position = Window.partitionBy(*group).orderBy("_e_us", "_e_id", ~arrived)
    earlier = by_position.rowsBetween(_UNBOUNDED, -1)
    tallies = _tallies(e)
    positional = [name for name in tallies if name == "n" or name.startswith("distinct_")]
    amount, us = F.when(arrived, F.col("_e_amount")), F.when(arrived, F.col("_e_us"))
    inside = {f"_w_{name}": F.sum(tallies[name]).over(earlier) for name in positional}
    inside["_w_first"] = F.min(us).over(by_position.rowsBetween(_UNBOUNDED, 0))
    inside["_w_last"] = F.max(us).over(earlier)
    if e.amounts:
        inside["_w_sum"] = F.sum(amount).over(earlier)
        inside["_w_var"] = F.var_pop(amount).over(earlier)
        inside["_w_max"] = F.max(amount).over(earlier)
    strictly = Window.partitionBy(*group).orderBy("_e_us").rangeBetween(_UNBOUNDED, -1)
    timed = {f"_w_{name}": F.sum(c).over(strictly) for name, c in tallies.items() if name not in positional}
    timed["_w_strict"] = F.sum(tallies["n"]).over(strictly)
    out = events.withColumns(inside).withColumns(timed)

    match = (F.col("_e_key") == F.col("_c_key")) & (F.col("_e_slice") == F.col("_c_slice"))
    out = out.join(carry, match, "left").where(arrived)

    def both(name: str, carried: str | None = None) -> Column:
        return F.coalesce(F.col(f"_w_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{carried or name}"), F.lit(0))

    def older(name: str, carried: str) -> Column:
        if "_c_begin" not in carry.columns:
            return both(name, carried)
        before = F.when(F.col("_e_us") == F.col("_c_begin"), F.col(f"_s_{carried}")).otherwise(F.col(f"_c_{carried}"))
        return F.coalesce(F.col(f"_w_{name}"), F.lit(0)) + F.coalesce(before, F.lit(0))

    final = {"_h_n": both("n"), "_h_strict": older("strict", "n")}
    final.update({f"_h_{name}": both(name) if name in positional else older(name, name) for name in tallies if name != "n"})
    final["_h_first"] = F.least("_w_first", "_c_first")
    final["_h_last"] = F.greatest("_w_last", "_c_last")
    if e.amounts:
        n_in, n_before, n_all = F.coalesce("_w_n", F.lit(0)), F.coalesce("_c_n", F.lit(0)), both("n")
        sum_in, sum_before = F.coalesce("_w_sum", F.lit(0.0)), F.coalesce("_c_sum", F.lit(0.0))
        gap = F.when((n_in > 0) & (n_before > 0), sum_in / n_in - sum_before / n_before).otherwise(F.lit(0.0))
        spread = F.coalesce(F.col("_w_var"), F.lit(0.0)) * n_in + F.coalesce("_c_spread", F.lit(0.0))
        spread = spread + gap * gap * n_in * n_before / F.greatest(n_all, F.lit(1))
        final["_h_mean"] = F.when(n_all > 0, (sum_in + sum_before) / n_all)
        final["_h_std"] = F.when(n_all > 0, F.sqrt(F.greatest(spread, F.lit(0.0)) / n_all))
        final["_h_max"] = F.greatest("_w_max", "_c_max")
    if keep is None:
        own = [F.col("_e_key"), F.col("_e_us").alias("_us"), F.col("_e_id"), F.col("_e_amount")]
    else:
        own = [F.col("_row")[c].alias(c) for c in keep]
    return out.select(*own, *[c.alias(name) for name, c in final.items()])


def pieces_of(rows: DataFrame, e: Entity, roles: Roles, block_rows: int) -> DataFrame:
    """The events of ``rows``, narrow, in pieces of at most ``block_rows`` events of one key."""
    events = events_of(rows, e, roles)
    for suffix, target in e.distinct:
        events = events.unionByName(first_meetings(rows, e, roles, suffix, target).drop("_target"), allowMissingColumns=True)
    # the kind parts events of one row that fall on one time
    order = [F.col("_e_us"), F.col("_e_id"), F.col("_e_kind") != ARRIVE, F.col("_e_kind")]
    return skew.in_pieces(events, "_e_key", order, block_rows, "_e_slice")


def piecewise_statistics(rows: DataFrame, e: Entity, roles: Roles, block_rows: int) -> DataFrame:
    """Raw statistics of rows whose keys are all heavy, with the columns that ``finish`` reads.

    Two totals are carried over each border: of all earlier events, for what goes by position, and of the
    strictly older ones, for what goes by time; so a border may fall into a run of equal times.
    """
    # windows and totals below read one shuffle of the events
    events = pieces_of(rows, e, roles, block_rows).repartition("_e_key", "_e_slice")
    ended = events.withColumn("_last", F.max("_e_us").over(Window.partitionBy("_e_key", "_e_slice")))
    tallies = _tallies(e)
    at_last = F.col("_e_us") == F.col("_last")
    # all totals of a piece come from one pass, and both carries from one row per piece
    pieces = slice_totals(ended, e, [
        F.min("_e_us").alias("_begin"), F.max("_last").alias("_last"), *[F.sum(F.when(at_last, tallies[n]).otherwise(F.lit(0))).alias(f"t_{n}") for n in timed_tallies(e)],
    ])
    carry = carry_in(pieces, e, strict=True)
    out = statistics_over(events, carry, e, None)
    kept = [F.col("_e_key").cast(rows.schema[e.key].dataType).alias(e.key), F.col("_us"), F.col("_e_id").alias(roles.id)]
    if e.amounts:
        kept.append(F.col("_e_amount").cast(rows.schema[roles.amount].dataType).alias(roles.amount))
    return out.select(*kept, *[c for c in out.columns if c.startswith("_h_")])
