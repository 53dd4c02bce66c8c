"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import over, stable, stable_sql
from ledgerlark.catalog.views import ROLES, tx_events, tx_orders
from ledgerlark.operators import profile as P
from ledgerlark.operators.history import Entity, add_history
from ledgerlark.session import scratch_folder
from ledgerlark.sources.transactions import write_features, write_report

GROUPS = ("tx_type", "os", "segment", "subnet", "receiver")
KEYS = ("account", "device", "receiver", "subnet")


def profile_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.basic_stats(tx_orders(spark, sf_dir), "label", "ts")


BASIC_SQL = over("tx_orders", """
select count(*)::bigint as n_rows, 12::bigint as n_cols, sum(label)::bigint as n_positives, round(avg(label), 6) as positive_rate,
  round_even(1 / avg(label), 0)::bigint as imbalance_1_to, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as date_min,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') as date_max,
  floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::bigint as span_days
from tx""")


def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats among line items, every third of which is there twice: full rows, and the order key."""
    once = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    items = once.unionByName(once.where("l_orderkey % 3 = 0"))
    rows = P.duplicate_rows(items).withColumn("what", F.lit("full_row")).withColumnRenamed("duplicates_full_row", "n")
    keys = P.duplicate_keys(items, "l_orderkey").withColumn("what", F.lit("key")).withColumnRenamed("duplicates_key", "n")
    return rows.unionByName(keys)


DUPLICATES_SQL = """
with items as (select * from lineitem union all select * from lineitem where l_orderkey % 3 = 0)
select 'full_row' as what, (count(*) - (select count(*) from (select distinct * from items)))::bigint as n
from items union all select 'key', (count(*) - count(distinct l_orderkey))::bigint from items"""


def profile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.missing_values(tx_orders(spark, sf_dir)).withColumn("view", F.lit("orders"))
    b = P.missing_values(tx_events(spark, sf_dir)).withColumn("view", F.lit("events"))
    return a.unionByName(b)


MISSING_SQL = over("tx_orders", """
select 'receiver' as "column", count(*) filter (receiver is null)::bigint as n_missing,
  round(count(*) filter (receiver is null) / count(*) * 100, 4) as pct, 'orders' as "view" from tx
union all select 'day_type', count(*) filter (not (event_id % 50 = 0 or event_id % 97 = 0))::bigint,
  round(count(*) filter (not (event_id % 50 = 0 or event_id % 97 = 0)) / count(*) * 100, 4), 'events' from events""")


def profile_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cardinality(tx_orders(spark, sf_dir))


_ORDER_COLUMNS = ("tx_id", "ts", "account", "device", "receiver", "subnet", "segment", "tx_type", "os", "amount", "label", "split")
CARDINALITY_SQL = over("tx_orders", " union all ".join(
    f"""select '{c}' as "column", count(distinct {c})::bigint as n_distinct from tx""" for c in _ORDER_COLUMNS))


def cardinality_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_cardinality(tx_orders(spark, sf_dir), 5)


CARDINALITY_TOP_SQL = f"select * from ({CARDINALITY_SQL}) order by n_distinct desc, \"column\" limit 5"


def breakdown_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.breakdown(tx_orders(spark, sf_dir), "label", GROUPS)


BREAKDOWN_SQL = over("tx_orders", " union all ".join(
    f"""select '{c}' as "column", {c}::varchar as "value", count(*)::bigint as n, sum(label)::bigint as n_positives,
  round(sum(label) / count(*) * 100, 4) as rate_pct from tx group by 2""" for c in GROUPS))


def lift_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.lift_table(tx_orders(spark, sf_dir), "label", ("tx_type", "os", "segment"))
    return out.withColumn("lift", F.round("lift", 2))


LIFT_SQL = over("tx_orders", "select \"column\", \"value\", n, n_positives, rate_pct, round(rate_pct / (g.rate * 100), 2) as lift from (" +
    " union all ".join(
    f"""select '{c}' as "column", {c}::varchar as "value", count(*)::bigint as n, sum(label)::bigint as n_positives,
  round(sum(label) / count(*) * 100, 3) as rate_pct from tx group by 2""" for c in ("tx_type", "os", "segment")) +
    ") b, (select avg(label) rate from tx) g")


def rate_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rate_by_quarter(tx_orders(spark, sf_dir), "label", "ts")


def rate_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rate_by_month(tx_orders(spark, sf_dir), "label", "ts")


def rate_by_hour_dow(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = tx_events(spark, sf_dir)
    hours = P.rate_by_hour(tx, "label", "ts").withColumn("part", F.lit("hour")).withColumnRenamed("hour", "value")
    days = P.rate_by_weekday(tx, "label", "ts").withColumn("part", F.lit("dow")).withColumnRenamed("dow", "value")
    return hours.unionByName(days)


def _rate_sql(view: str, expr: str, name: str, extra: str = "") -> str:
    return f"""select {expr} as {name}, count(*)::bigint as n, sum(label)::bigint as n_positives,
  round(sum(label) / count(*) * 100, 4) as rate_pct{extra} from tx group by 1"""


QUARTER_SQL = over("tx_orders", _rate_sql("tx", "year(ts) || 'Q' || quarter(ts)", "quarter"))
MONTH_SQL = over("tx_orders", _rate_sql("tx", "strftime(ts, '%Y-%m')", '"month"'))
HOUR_SQL = over("tx_events", _rate_sql("tx", "hour(ts)::bigint", '"value"', ", 'hour' as part") + " union all " +
                _rate_sql("tx", "(isodow(ts) - 1)::bigint", '"value"', ", 'dow' as part"))


def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.entity_summary(tx_orders(spark, sf_dir), KEYS, "label")
    return out.withColumns({c: stable(F.col(c), 4) for c in ("rows_p50", "rows_p90", "rows_p99")})


ENTITY_SQL = over("tx_orders", " union all ".join(
    f"""select '{c}' as entity, count(*)::bigint as n_keys, round(avg(n), 3) as rows_mean, max(n)::bigint as rows_max,
  count(*) filter (pos > 0)::bigint as keys_with_positive, count(*) filter (pos = n)::bigint as keys_only_positive,
  {stable_sql('quantile_cont(n, 0.5)', 4)} as rows_p50, {stable_sql('quantile_cont(n, 0.9)', 4)} as rows_p90,
  {stable_sql('quantile_cont(n, 0.99)', 4)} as rows_p99
from (select {c}, count(*) n, sum(label) pos from tx where {c} is not null group by 1)""" for c in KEYS))


def key_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.key_histogram(tx_orders(spark, sf_dir), "account").select(F.col("rows_per_key").cast("bigint").alias("rows_per_key"), "n_keys")


KEY_HISTOGRAM_SQL = over("tx_orders", """
select least(n, 10)::bigint as rows_per_key, count(*)::bigint as n_keys from (select account, count(*) n from tx group by 1) group by 1""")


def partner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.partner_counts(tx_orders(spark, sf_dir), "device", "account")


PARTNER_SQL = over("tx_orders", """
select count(*)::bigint as n_keys, count(*) filter (p >= 3)::bigint as keys_ge_3, count(*) filter (p >= 10)::bigint as keys_ge_10
from (select device, count(distinct account) p from tx group by 1)""")


def partner_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.partner_histogram(tx_orders(spark, sf_dir), "receiver", "device").select(
        F.col("partners").cast("bigint").alias("partners"), "n_keys"
    )


PARTNER_HISTOGRAM_SQL = over("tx_orders", """
select least(p, 50)::bigint as partners, count(*)::bigint as n_keys
from (select receiver, count(distinct device) p from tx where receiver is not null group by 1) group by 1""")


def risky_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.risky_keys(tx_orders(spark, sf_dir), "account", "label", 3, 0.5)


RISKY_SQL = over("tx_orders", """
select count(*) filter (rate = 1)::bigint as keys_all_positive, count(*) filter (n >= 3 and rate >= 0.5)::bigint as keys_high_rate
from (select account, count(*) n, avg(label) rate from tx group by 1)""")


def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = (Entity("device", "device", True, (7,), (("accounts", "account"),)), Entity("receiver", "receiver", age=True))
    tx = add_history(tx_events(spark, sf_dir), entities, ROLES)
    names = ("device_tx_count_7d", "device_distinct_accounts_all", "receiver_first_seen_days_ago", "amount")
    out = P.describe_features(tx, names)
    return out.select("feature", *[stable(F.col(c), 4).alias(c) for c in ("mean", "std", "max", "p50", "p90", "p99")])


_DESCRIBED = {
    "device_tx_count_7d": "count(*) over (partition by device order by epoch_us(ts) range between 604800000000 preceding and 1 preceding)::double",
    "device_distinct_accounts_all": "count(distinct account) over (partition by device order by ts, tx_id rows between unbounded preceding and 1 preceding)::double",
    "receiver_first_seen_days_ago": "floor((epoch_us(ts) - min(epoch_us(ts)) over (partition by receiver)) / 1000000.0) / 86400.0",
    "amount": "amount",
}
DESCRIBE_SQL = over("tx_events", ", f as (select " + ", ".join(f"{v} as {k}" for k, v in _DESCRIBED.items()) + " from tx)\n" +
    " union all ".join(
    f"select '{c}' as feature, {stable_sql(f'avg({c})', 4)} as mean, {stable_sql(f'stddev_samp({c})', 4)} as std, "
    f"{stable_sql(f'max({c})', 4)} as max, " + ", ".join(
        f"{stable_sql(f'quantile_cont({c}, {q})', 4)} as {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) +
    " from f" for c in _DESCRIBED))


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = [("amount", F.col("amount"), 0, 400), ("amount_log", F.log1p("amount"), 0, 7), ("account", F.col("account").cast("double"), 500, 8500)]
    out = P.class_histogram(tx_events(spark, sf_dir), "label", ranges)
    return out.select("feature", F.col("class").cast("bigint").alias("class"), F.col("bin").cast("bigint").alias("bin"), "n")


def _bin(v: str, lo: float, hi: float, bins: int = 20) -> str:
    return f"case when {v} < {lo} then 0 when {v} >= {hi} then {bins + 1} else floor(({v} - {lo}) / ({hi} - {lo}) * {bins}) + 1 end::bigint"


HISTOGRAM_SQL = over("tx_events", " union all ".join(
    f"select '{n}' as feature, label::bigint as class, {_bin(v, lo, hi)} as bin, count(*)::bigint as n from tx group by 2, 3"
    for n, v, lo, hi in (("amount", "amount", 0, 400), ("amount_log", "ln(1 + amount)", 0, 7), ("account", "account", 500, 8500))))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.label_counts(tx_orders(spark, sf_dir), "label")
    naive = P.naive_accuracy(tx_orders(spark, sf_dir), "label").scalar()
    return out.select(F.col("label").cast("bigint").alias("label"), "n", stable(naive).alias("naive_accuracy"))


LABEL_SQL = over("tx_orders", f"""
select label::bigint as label, count(*)::bigint as n, (select {stable_sql('1 - avg(label)')} from tx) as naive_accuracy from tx group by 1""")


def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by split and read back from their partitions, next to a report written as JSON."""
    folder = scratch_folder(spark, "reports")
    write_features(tx_orders(spark, sf_dir), f"{folder}/rows")
    write_report(P.rate_by_month(tx_orders(spark, sf_dir), "label", "ts"), f"{folder}/months")
    rows = spark.read.parquet(f"{folder}/rows").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    months = spark.read.json(f"{folder}/months").agg(F.lit("months").alias("split"), F.count(F.lit(1)).alias("n"))
    return rows.unionByName(months)


WRITTEN_SQL = over("tx_orders", """
select split, count(*)::bigint as n from tx group by 1 union all select 'months', count(distinct strftime(ts, '%Y-%m'))::bigint from tx""")

QUERIES = {f.__name__: f for f in (
    profile_basic, profile_duplicates, profile_missing, profile_cardinality, cardinality_top, breakdown_all, lift_table,
    rate_by_quarter, rate_by_month, rate_by_hour_dow, entity_summary, key_histogram, partner_counts, partner_histogram,
    risky_keys, describe_features, class_histogram, label_counts, written_reports)}
ORACLES = {
    "profile_basic": BASIC_SQL,
    "profile_duplicates": DUPLICATES_SQL,
    "profile_missing": MISSING_SQL,
    "profile_cardinality": CARDINALITY_SQL,
    "cardinality_top": CARDINALITY_TOP_SQL,
    "breakdown_all": BREAKDOWN_SQL,
    "lift_table": LIFT_SQL,
    "rate_by_quarter": QUARTER_SQL,
    "rate_by_month": MONTH_SQL,
    "rate_by_hour_dow": HOUR_SQL,
    "entity_summary": ENTITY_SQL,
    "key_histogram": KEY_HISTOGRAM_SQL,
    "partner_counts": PARTNER_SQL,
    "partner_histogram": PARTNER_HISTOGRAM_SQL,
    "risky_keys": RISKY_SQL,
    "describe_features": DESCRIBE_SQL,
    "class_histogram": HISTOGRAM_SQL,
    "label_counts": LABEL_SQL,
    "written_reports": WRITTEN_SQL,
}
