"""History of score requests from stored totals, as of each request's own time.

The totals of a key after each of its times are written once. A request looks them up at its time and at
the times where its windows and label lags begin; every feature is a difference or quotient of such
totals, so a batch of requests costs one as-of join per entity and reads no raw history. All history that
counts is strictly older than the request; what a request leaves out takes its neutral value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators import skew
from ledgerlark.operators.asof import asof_answers
from ledgerlark.operators.history import finish
from ledgerlark.operators.history_spec import DAY_US, Entity, Roles
from ledgerlark.session import pin

_SUMS = ("n", "k", "s1", "s2")


def history_totals(df: DataFrame, e: Entity, roles: Roles = Roles(), centre: float = 0.0, block_rows: int = skew.BLOCK_ROWS) -> DataFrame:
    """key, at (microseconds) and the totals of all rows of the key up to then, one row per key and time.

    Rows and labels are counted; amounts are summed around ``centre`` (near their mean, so that squares keep
    their digits). Keys of any size are cut into pieces, and each piece is given the totals before it.
    """
    known = df.withColumn("_us", F.unix_micros(F.col(roles.ts).cast("timestamp"))).where(F.col(e.key).isNotNull() & F.col("_us").isNotNull())
    off = F.col(roles.amount).cast("double") - F.lit(centre)
    label = F.coalesce(F.col(roles.label).cast("bigint"), F.lit(0)) if e.rates else F.lit(0).cast("bigint")
    met = [f"met_{s}" for s, _ in e.distinct]
    steps = known.select(
        F.col(e.key).alias("key"), F.col("_us").alias("at"), F.lit(1).cast("bigint").alias("n"), label.alias("k"), off.alias("s1"), (off * off).alias("s2"),
        F.col(roles.amount).cast("double").alias("top"), F.col("_us").alias("first"), *[F.lit(0).cast("bigint").alias(m) for m in met],
    )
    for s, target in e.distinct:
        # only the time of a meeting counts here, so it is folded without the id that parts rows of one time
        firsts = known.groupBy(F.col(e.key).alias("key"), F.col(target).alias("_target")).agg(F.min("_us").alias("at")).select("key", "at", F.lit(1).cast("bigint").alias(f"met_{s}"))
        steps = steps.unionByName(firsts, allowMissingColumns=True)
    sums = [*_SUMS, *met]
    folded = steps.groupBy("key", "at").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.max("top").alias("top"), F.min("first").alias("first"))
    pieces = skew.in_pieces(folded, "key", [F.col("at")], block_rows).repartition("key", "_piece")
    upto = Window.partitionBy("key", "_piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    each = pieces.groupBy("key", "_piece").agg(*[F.sum(c).alias(c) for c in sums], F.max("top").alias("top"), F.min("first").alias("first"))
    carried = each.select(
        F.col("key").alias("_k"), F.col("_piece").alias("_p"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_c_{c}") for c in sums],
        F.max("top").over(before).alias("_c_top"), F.min("first").over(before).alias("_c_first"),
    )
    both = pieces.select("key", "_piece", "at", *[F.sum(c).over(upto).alias(c) for c in sums], F.max("top").over(upto).alias("top"), F.min("first").over(upto).alias("first"))
    joined = both.join(carried, (F.col("key") == F.col("_k")) & (F.col("_piece") == F.col("_p")))
    return joined.select("key", "at", *[(F.col(c) + F.col(f"_c_{c}")).alias(c) for c in sums], F.greatest("top", "_c_top").alias("top"), F.least("first", "_c_first").alias("first"))


def _lookups(e: Entity) -> dict[str, int]:
    """Name of a lookup and how long before the request it is."""
    found = {"now": 0, **{f"out_{w}": w * DAY_US for w in e.windows}}
    for i, r in enumerate(e.rates):
        found[f"known_{i}"] = r.lag_days * DAY_US
        if r.window_days is not None:
            found[f"gone_{i}"] = (r.lag_days + r.window_days) * DAY_US
    return found


def request_history(requests: DataFrame, totals: Mapping[str, DataFrame], entities: Sequence[Entity], prior: float, roles: Roles = Roles(),
                    centre: float = 0.0, hot_rows: int | None = skew.HOT_ROWS, block_rows: int = skew.BLOCK_ROWS) -> DataFrame:
    """Add the history columns of every entity to each request; ``totals`` holds a table per entity name.

    Requests may repeat ids: rows of one id, key and time get the same history.
    """
    out = requests
    for e in entities:
        out = _with_entity(out, totals[e.name], e, prior, roles, centre, hot_rows, block_rows)
    return out


def _with_entity(requests: DataFrame, totals: DataFrame, e: Entity, prior: float, roles: Roles, centre: float, hot_rows: int | None, block_rows: int) -> DataFrame:
    us = F.unix_micros(F.col(roles.ts).cast("timestamp"))
    values = ("n", "k", "s1", "s2", "top", "first", *[f"met_{s}" for s, _ in e.distinct])
    times = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(back).cast("bigint").alias("back")) for name, back in _lookups(e).items()]))
    asked = requests.select(F.col(roles.id).alias("_r_id"), F.col(e.key).alias("key"), us.alias("_r_us"))
    # repeated requests go before they are taken apart, and the search reads the rest several times
    asks = pin(asked.where("key is not null and _r_us is not null").dropDuplicates()).select("*", times.alias("_t"))
    # strictly older: the last microsecond before
    asks = asks.select(F.struct("_r_id", "_r_us", F.col("_t.name").alias("name")).alias("_ask_id"), "key", F.timestamp_micros(F.col("_r_us") - F.col("_t.back") - 1).alias("at"))
    stored = totals.withColumn("at", F.timestamp_micros("at"))
    # an id that says what was asked brings the answers together without another join with the asks
    answers = asof_answers(asks, stored, "key", "at", values, "_ask_id", hot_rows=hot_rows, block_rows=block_rows)
    found = answers.select(F.col("_id._r_id").alias("_r_id"), F.col("_k").alias("key"), F.col("_id._r_us").alias("_r_us"), F.col("_id.name").alias("_name"), "_found")

    def at(name: str, value: str):
        return F.max(F.when(F.col("_name") == name, F.col("_found")[value]))

    raw = {"_h_n": at("now", "n"), "_h_strict": at("now", "n"), "_s1": at("now", "s1"), "_s2": at("now", "s2"), "_h_max": at("now", "top"), "_h_first": at("now", "first")}
    raw |= {f"_h_out_{w}": at(f"out_{w}", "n") for w in e.windows} | {f"_h_distinct_{s}": at("now", f"met_{s}") for s, _ in e.distinct}
    for i, r in enumerate(e.rates):
        for name, value in (("known", "n"), ("hits", "k")):
            raw[f"_h_{name}_{i}"] = at(f"known_{i}", value)
            if r.window_days is not None:
                raw[f"_h_{name}_{i}"] = F.coalesce(raw[f"_h_{name}_{i}"], F.lit(0)) - F.coalesce(at(f"gone_{i}", value), F.lit(0))
    wide = found.groupBy("_r_id", "key", "_r_us").agg(*[c.alias(name) for name, c in raw.items()])
    n = F.nullif(F.col("_h_n"), F.lit(0))
    mean = F.col("_s1") / n
    wide = wide.withColumns({
        "_h_mean": mean + F.lit(centre), "_h_std": F.sqrt(F.greatest(F.col("_s2") / n - mean * mean, F.lit(0.0))),
        "_h_first": F.coalesce("_h_first", "_r_us"), **{f"_h_out_{w}": F.coalesce(f"_h_out_{w}", F.lit(0)) for w in e.windows},
    }).withColumnRenamed("key", "_r_key")
    match = F.col(roles.id).eqNullSafe(F.col("_r_id")) & F.col(e.key).eqNullSafe(F.col("_r_key")) & us.eqNullSafe(F.col("_r_us"))
    joined = requests.join(wide, match, "left").drop("_r_id", "_r_key", "_r_us", "_s1", "_s2").withColumn("_us", us)
    return finish(joined, e, roles, prior).drop("_us")
