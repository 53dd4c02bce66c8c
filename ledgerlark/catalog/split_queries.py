"""Splits, overlap, seen keys, folds, samples, and the as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import over, scored_events, scored_sql, stable, stable_sql
from ledgerlark.catalog.views import tx_events, tx_orders
from ledgerlark.operators import overlap as O
from ledgerlark.operators import splits as S
from ledgerlark.operators.asof import asof_join

BOUNDS = S.TimeSplit("1998-12-31 23:59:59", "1999-01-15 00:00:00", "1999-11-30 23:59:59", "2000-01-01 00:00:00", "2000-12-31 23:59:59")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = S.time_split(tx_orders(spark, sf_dir), "ts", BOUNDS, "part")
    return tx.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("n_positives"))


PART_SQL = """case when ts <= timestamp '1998-12-31 23:59:59' then 'train'
  when ts between timestamp '1999-01-15 00:00:00' and timestamp '1999-11-30 23:59:59' then 'val'
  when ts between timestamp '2000-01-01 00:00:00' and timestamp '2000-12-31 23:59:59' then 'test' end"""
SPLIT_SQL = over("tx_orders", f"select {PART_SQL} as part, count(*)::bigint as n, sum(label)::bigint as n_positives from tx group by 1")


def split_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_days(tx_events(spark, sf_dir), "ts")


DAYS_SQL = over("tx_events", """
select split, greatest(1, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000))::bigint as days from tx group by 1""")


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.random_split(tx_orders(spark, sf_dir), "tx_id", 0.2, seed=42, name="part")
    return out.select("tx_id", "part")


RANDOM_SQL = over("tx_orders", f"""
select tx_id, case when h < '{int(0.2 * 2**32):08x}' then 'test' when h < '{int((0.2 + 0.1) * 2**32):08x}' then 'val' else 'train' end as part
from (select tx_id, substr(md5('42:' || tx_id), 1, 8) as h from tx)""")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(tx_orders(spark, sf_dir), "tx_id", "label", name="part").select("tx_id", "part")


STRATIFIED_SQL = over("tx_orders", """
select tx_id, case when rn <= floor(n * 0.2) then 'test' when rn <= floor(n * 0.2) + floor(n * 0.1) then 'val' else 'train' end as part
from (select tx_id, row_number() over (partition by label order by md5('42:' || tx_id), tx_id) rn, count(*) over (partition by label) n from tx)""")


def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = tx_orders(spark, sf_dir)
    train, test = tx.where("split = 'train'"), tx.where("split = 'test'")
    return O.entity_overlap(train, test, ("account", "device", "receiver", "subnet"))


OVERLAP_SQL = over("tx_orders", " union all ".join(f"""
select '{c}' as entity, sum(a)::bigint as n_unique_a, sum(b)::bigint as n_unique_b, sum(a * b)::bigint as n_overlap,
  round(sum(a * b) / greatest(sum(b), 1) * 100, 2) as pct_of_b_seen_in_a
from (select {c}, max((split = 'train')::int) a, max((split = 'test')::int) b from tx where split in ('train', 'test') group by 1)"""
    for c in ("account", "device", "receiver", "subnet")))


def seen_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = tx_orders(spark, sf_dir)
    marked = O.mark_seen(tx.where("split = 'test'"), tx.where("split = 'train'"), "account")
    return marked.select("tx_id", "seen")


SEEN_SQL = over("tx_orders", """
select tx_id, account in (select account from tx where split = 'train') as seen from tx where split = 'test'""")


def seen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts by the semi and the anti join."""
    tx = tx_orders(spark, sf_dir)
    test, train = tx.where("split = 'test'"), tx.where("split = 'train'")
    parts = O.seen_rows(test, train, "receiver").withColumn("part", F.lit("seen")).unionByName(
        O.unseen_rows(test, train, "receiver").withColumn("part", F.lit("unseen")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), stable(F.avg("label")).alias("rate"))


SEEN_ROWS_SQL = over("tx_orders", f"""
, k as (select distinct receiver from tx where split = 'train' and receiver is not null)
select case when k.receiver is null then 'unseen' else 'seen' end as part, count(*)::bigint as n, {stable_sql('avg(label)')} as rate
from tx left join k on tx.receiver = k.receiver where split = 'test' group by 1""")


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = tx_events(spark, sf_dir)
    both = O.stack_with_flag(tx.where("split = 'train'"), tx.where("split = 'test'"))
    return both.groupBy(F.col("is_test").cast("bigint").alias("is_test"), "tx_type").agg(F.count(F.lit(1)).alias("n"))


STACKED_SQL = over("tx_events", """
select (split = 'test')::bigint as is_test, tx_type, count(*)::bigint as n from tx where split in ('train', 'test') group by 1, 2""")


def time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.time_folds(tx_orders(spark, sf_dir), "ts", "tx_id").select("tx_id", F.col("fold").cast("bigint").alias("fold"))


FOLDS_SQL = over("tx_orders", """
select tx_id, case when rn <= floor(n * 0.25) then 0 when rn <= floor(n * 0.5) then 1 when rn <= floor(n * 0.75) then 2 else 3 end::bigint as fold
from (select tx_id, row_number() over (order by ts, tx_id) rn, count(*) over () n from tx)""")


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.seeded_sample(tx_events(spark, sf_dir), "tx_id", 2000).select("tx_id", "label")


SAMPLE_SQL = over("tx_events", "select tx_id, label from tx order by md5('0:' || tx_id), tx_id limit 2000")


def permuted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels exchanged inside train and validation, test labels kept."""
    out = S.reshuffle(tx_events(spark, sf_dir), ["label"], "ts", "tx_id", 0, F.col("split") != "test")
    return out.select("tx_id", F.col("label").cast("bigint").alias("label"))


PERMUTED_SQL = over("tx_events", """
, t as (select tx_id, row_number() over (order by ts, tx_id) rn from tx where split <> 'test'),
g as (select label, row_number() over (order by md5('0:' || tx_id), tx_id) rn from tx where split <> 'test')
select t.tx_id, g.label::bigint as label from t join g using (rn) union all select tx_id, label::bigint from tx where split = 'test'""")


def example_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.example_rows(scored_events(spark, sf_dir), "label", "score", ("ts", "tx_id"), 0.3, 0.2)
    return out.select("case", "tx_id", "score")


EXAMPLES_SQL = scored_sql("""
select "case", tx_id, score from (select *, row_number() over (partition by "case" order by ts, tx_id) rn from (
  select *, case when score > 0.3 and label = 1 then 'true_positive' when score > 0.3 then 'false_positive'
    when score < 0.2 and label = 1 then 'missed_positive' end as "case" from s) where "case" is not null) where rn = 1""")


def _snapshots(tx: DataFrame) -> DataFrame:
    """Purchases play the part of feature-store snapshots."""
    return tx.where("tx_type = 'purchase'").select("device", "ts", "tx_id", "amount")


def _asof(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    tx = tx_events(spark, sf_dir)
    asks = tx.where("tx_type <> 'purchase'").select("tx_id", "device", "ts")
    out = asof_join(asks, _snapshots(tx), "device", "ts", ("tx_id", "amount"), "tx_id", **kw)
    return out.select("tx_id", "asof_tx_id", "asof_amount")


def asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir)


def asof_heavy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, hot_rows=50, block_rows=64)


ASOF_SQL = over("tx_events", """
select a.tx_id, s.tx_id as asof_tx_id, s.amount as asof_amount
from (select * from tx where tx_type <> 'purchase') a
asof left join (select * from tx where tx_type = 'purchase') s on a.device = s.device and a.ts >= s.ts""")

def asof_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of whole days, many of them for one key on one day: the largest id counts."""
    tx = tx_orders(spark, sf_dir)
    snaps = tx.where("tx_id % 3 <> 0").select("subnet", "ts", "tx_id", "amount")
    asks = tx.where("tx_id % 3 = 0").select("tx_id", "subnet", "ts")
    return asof_join(asks, snaps, "subnet", "ts", ("tx_id", "amount"), "tx_id", hot_rows=50, block_rows=64).select("tx_id", "asof_tx_id", "asof_amount")


ASOF_TIES_SQL = over("tx_orders", """
, s as (select subnet, ts, tx_id, amount from tx where tx_id % 3 <> 0
        qualify row_number() over (partition by subnet, ts order by tx_id desc) = 1)
select a.tx_id, s.tx_id as asof_tx_id, s.amount as asof_amount
from (select * from tx where tx_id % 3 = 0) a asof left join s on a.subnet = s.subnet and a.ts >= s.ts""")

# half of all rows belong to one device, and all its snapshots fall on one midnight
_ONE_DAY = {
    "device": "case when tx_id % 2 = 0 then 1 else device end",
    "ts": "case when tx_id % 2 = 0 and tx_type = 'purchase' then timestamp '2024-01-15 00:00:00' when tx_id % 6 = 2 then date_trunc('day', ts) else ts end",
}


def asof_one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key with all its snapshots on one day: its run of equal times spans many pieces."""
    tx = tx_events(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _ONE_DAY.items()})
    asks = tx.where("tx_type <> 'purchase'").select("tx_id", "device", "ts", "segment")
    snaps = tx.where("tx_type = 'purchase'").select("device", "ts", "tx_id", "amount")
    return asof_join(asks, snaps, "device", "ts", ("tx_id", "amount"), "tx_id", hot_rows=50, block_rows=64).select("tx_id", "segment", "asof_tx_id", "asof_amount")


ASOF_ONE_DAY_SQL = over("tx_events", f"""
, d as (select * replace ({", ".join(f"{e} as {c}" for c, e in _ONE_DAY.items())}) from tx)
, s as (select * from d where tx_type = 'purchase' qualify row_number() over (partition by device, ts order by tx_id desc) = 1)
select a.tx_id, a.segment, s.tx_id as asof_tx_id, s.amount as asof_amount
from (select * from d where tx_type <> 'purchase') a asof left join s on a.device = s.device and a.ts >= s.ts""")

QUERIES = {f.__name__: f for f in (
    split_counts, split_days, random_split, stratified_split, entity_overlap, seen_unseen, seen_rows, stacked, time_folds,
    seeded_sample, permuted_labels, example_rows, asof_features, asof_heavy_keys, asof_ties, asof_one_day)}
ORACLES = {
    "split_counts": SPLIT_SQL,
    "split_days": DAYS_SQL,
    "random_split": RANDOM_SQL,
    "stratified_split": STRATIFIED_SQL,
    "entity_overlap": OVERLAP_SQL,
    "seen_unseen": SEEN_SQL,
    "seen_rows": SEEN_ROWS_SQL,
    "stacked": STACKED_SQL,
    "time_folds": FOLDS_SQL,
    "seeded_sample": SAMPLE_SQL,
    "permuted_labels": PERMUTED_SQL,
    "example_rows": EXAMPLES_SQL,
    "asof_features": ASOF_SQL,
    "asof_heavy_keys": ASOF_SQL,
    "asof_ties": ASOF_TIES_SQL,
    "asof_one_day": ASOF_ONE_DAY_SQL,
}
