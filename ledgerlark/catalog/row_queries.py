"""Row features, rule scores, bands and table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import EFT, RULE_SQL, RULES, over, scored_events, scored_sql, stable, stable_sql
from ledgerlark.catalog.views import table, tx_events, tx_orders
from ledgerlark.functions import rows as R
from ledgerlark.operators import encoding
from ledgerlark.sources import transactions as S


def instant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = R.RowColumns("amount", "ts", "day_type", "os", (("os_l1h", "l1h"), ("os_l8h", "l8h")), None)
    df = R.add_row_features(tx_events(spark, sf_dir), cols)
    df = df.withColumn("day_type_normal", R.day_type_clean(F.col("day_type"), "normal"))
    return df.select(
        "tx_id", stable(F.col("amount_log")).alias("amount_log"), "amount_bucket",
        *[F.col(c).cast("bigint").alias(c) for c in ("is_round_amount", "amount_cents", "hour", "dow", "is_weekend", "is_holiday")],
        F.col("DayType_clean").alias("day_type_clean"), "day_type_normal", "os_l1h", "os_l8h",
    )


INSTANT_SQL = over("tx_events", f"""
select tx_id, {stable_sql('ln(1 + greatest(amount, 0.0))')} as amount_log,
  case when amount is null or amount <= -1 then 'nan' when amount <= 1000 then '0-1k' when amount <= 5000 then '1k-5k'
    when amount <= 10000 then '5k-10k' when amount <= 25000 then '10k-25k' when amount <= 50000 then '25k-50k'
    when amount <= 100000 then '50k-100k' else '100k+' end as amount_bucket,
  (amount % 100 = 0)::bigint as is_round_amount,
  (round_even(amount * 100, 0)::bigint % 100)::bigint as amount_cents,
  hour(ts)::bigint as hour, (isodow(ts) - 1)::bigint as dow, (isodow(ts) >= 6)::bigint as is_weekend,
  (day_type is not null)::bigint as is_holiday,
  coalesce(day_type, 'Unknown') as day_type_clean, coalesce(day_type, 'Normal') as day_type_normal,
  coalesce(os, 'None') || '_' || l1h as os_l1h, coalesce(os, 'None') || '_' || l8h as os_l8h
from tx""")


def amount_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tx_orders(spark, sf_dir)
    return df.select(
        "tx_id", R.amount_bucket(F.col("amount")).alias("amount_bucket"),
        R.is_round_amount(F.col("amount")).cast("bigint").alias("is_round_amount"),
        R.amount_cents(F.col("amount")).alias("amount_cents"),
        R.crossed(F.col("os"), F.col("receiver")).alias("os_receiver"),
    )


AMOUNT_SQL = over("tx_orders", """
select tx_id,
  case when amount is null or amount <= -1 then 'nan' when amount <= 1000 then '0-1k' when amount <= 5000 then '1k-5k'
    when amount <= 10000 then '5k-10k' when amount <= 25000 then '10k-25k' when amount <= 50000 then '25k-50k'
    when amount <= 100000 then '50k-100k' else '100k+' end as amount_bucket,
  (amount % 100 = 0)::bigint as is_round_amount,
  (round_even(amount * 100, 0)::bigint % 100)::bigint as amount_cents,
  coalesce(os, 'None') || '_' || coalesce(receiver::varchar, 'None') as os_receiver
from tx""")


def brand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names stand in for device models; a spelling per part size reaches every rule."""
    part = table(spark, sf_dir, "part")
    words = ("iPhone 13", "samsung A5", "SM-G1", "Redmi 9", "mi 10", "XIAOMI 12", "HUAWEI P30", "Hua x", "Oppo A9", "vivo Y",
             "realme 8", "Pixel 7", "OnePlus 9", "LG K", "Honor 8", "TCL 20", "plain", "mini", "the mi 3")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % len(words) + 1).cast("int"))
    model = F.when(F.col("p_size") % 7 == 0, F.lit(None)).when(F.col("p_size") % 7 == 1, F.col("p_name"))
    model = model.otherwise(F.concat_ws(" ", word, F.col("p_name")))
    return part.select("p_partkey", model.alias("model"), R.device_brand(model).alias("brand"))


BRAND_SQL = """
with m as (select p_partkey, case when p_size % 7 = 0 then null when p_size % 7 = 1 then p_name
  else ['iPhone 13','samsung A5','SM-G1','Redmi 9','mi 10','XIAOMI 12','HUAWEI P30','Hua x','Oppo A9','vivo Y',
        'realme 8','Pixel 7','OnePlus 9','LG K','Honor 8','TCL 20','plain','mini','the mi 3'][(p_partkey % 19 + 1)::int]
       || ' ' || p_name end as model from part), l as (select *, lower(model) as x from m)
select p_partkey, model,
  case when model is null then 'Unknown' when x like '%iphone%' then 'iPhone'
    when x like '%samsung%' or x like 'sm-%' then 'Samsung'
    when x like '%redmi%' or x like '%xiaomi%' or x like 'mi %' then 'Xiaomi'
    when x like 'hua%' or x like '%huawei%' then 'Huawei' when x like '%oppo%' then 'Oppo' when x like '%vivo%' then 'Vivo'
    when x like '%realme%' then 'Realme' when x like '%google%' or x like '%pixel%' then 'Google'
    when x like '%oneplus%' then 'OnePlus' when x like '%lg%' then 'LG' when x like '%honor%' then 'Honor'
    when x like '%tcl%' then 'TCL' else 'Other' end as brand
from l"""


def top_n_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names beyond the 100 most frequent of the odd-sized parts become one level."""
    part = table(spark, sf_dir, "part")
    levels = encoding.fit_top_levels(part.where("p_size % 2 = 1"), "p_name", 100)
    return encoding.apply_top_levels(part.select("p_partkey", "p_name"), "p_name", levels)


TOP_N_SQL = """
with top as (select p_name from (select p_name, count(*) n from part where p_size % 2 = 1 group by 1)
             order by n desc, p_name limit 100)
select p_partkey, case when p_name in (select p_name from top) then p_name else '_OTHER_' end as p_name from part"""


def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = tx_events(spark, sf_dir)
    return tx.select("tx_id", stable(R.rule_score(RULES, eft=EFT)).alias("score"))


def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_events(spark, sf_dir)
    out = R.add_bands(scored, "score", {"HIGH": 0.6, "MEDIUM": 0.35})
    return out.select("tx_id", "risk_band", "threshold_used", "is_fraud", "action")


BANDS_SQL = scored_sql("""
select tx_id, band as risk_band, case when band = 'HIGH' then 0.6 else 0.35 end::double as threshold_used,
  band in ('HIGH', 'MEDIUM') as is_fraud,
  case band when 'HIGH' then 'BLOCK_OR_STEP_UP' when 'MEDIUM' then 'MANUAL_REVIEW' else 'ALLOW' end as action
from (select *, case when score >= 0.6 then 'HIGH' when score >= 0.35 then 'MEDIUM' else 'LOW' end as band from s)""")


def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.add_bands(scored_events(spark, sf_dir), "score")
    return out.groupBy("risk_band", "action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("n_positives"))


BAND_COUNTS_SQL = scored_sql("""
select band as risk_band, case band when 'HIGH' then 'BLOCK_OR_STEP_UP' when 'MEDIUM' then 'MANUAL_REVIEW' else 'ALLOW' end as action,
  count(*)::bigint as n, sum(label)::bigint as n_positives
from (select *, case when score >= 0.95 then 'HIGH' when score >= 0.5 then 'MEDIUM' else 'LOW' end as band from s) group by 1, 2""")


def history_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that carry a map of history values; what is absent gets its neutral value."""
    tx = tx_events(spark, sf_dir)
    pairs = F.create_map(
        F.lit("device_tx_count_7d"), (F.col("tx_id") % 13).cast("double"),
        F.when(F.col("tx_id") % 2 == 0, "receiver_fraud_rate_smoothed").otherwise("unused"), (F.col("tx_id") % 5) / 5,
    )
    sent = tx.withColumn("historical_features", F.when(F.col("tx_id") % 3 > 0, pairs))
    names = ("device_tx_count_7d", "receiver_fraud_rate_smoothed", "device_amount_ratio_to_mean")
    return R.expand_history(sent, names, 0.01).select("tx_id", *names)


DEFAULTS_SQL = over("tx_events", """
select tx_id, case when tx_id % 3 > 0 then (tx_id % 13)::double else 0.0 end::double as device_tx_count_7d,
  case when tx_id % 3 > 0 and tx_id % 2 = 0 then (tx_id % 5) / 5.0 else 0.01 end::double as receiver_fraud_rate_smoothed,
  1.0::double as device_amount_ratio_to_mean
from tx""")

EXPECTED = ("tx_id", "ts", "account", "device", "receiver", "amount", "label", "BusinessKey", "ReceiverName")


def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.check_schema(tx_orders(spark, sf_dir), EXPECTED)
    return got.select("ok", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "n_rows", "n_cols")


SCHEMA_SQL = over("tx_orders", """
select false as ok, 'BusinessKey,ReceiverName' as missing, 'subnet,segment,tx_type,os,split' as extra,
  count(*)::bigint as n_rows, 12::bigint as n_cols from tx""")


def order_rules():
    c = F.col
    return {
        "receiver_present": c("receiver").isNotNull(),
        "amount_range": c("amount") >= 1000,
        "label_flag": c("label").between(0, 1),
        "os_known": c("os").isin("F", "O"),
    }


def row_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.violation_counts(tx_orders(spark, sf_dir), order_rules())


CONSTRAINTS_SQL = over("tx_orders", """
select rule, count(*)::bigint as n_rows, sum(bad)::bigint as n_broken from (
  select 'receiver_present' as rule, (receiver is null)::int as bad from tx
  union all select 'amount_range', (not coalesce(amount >= 1000, false))::int from tx
  union all select 'label_flag', (not coalesce(label between 0 and 1, false))::int from tx
  union all select 'os_known', (not coalesce(os in ('F', 'O'), false))::int from tx) group by 1""")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = S.split_valid(tx_orders(spark, sf_dir), order_rules())
    return bad.select("tx_id", F.array_join("violations", ",").alias("violations"))


QUARANTINE_SQL = over("tx_orders", """
select tx_id, violations from (select tx_id, concat_ws(',', case when receiver is null then 'receiver_present' end,
  case when not coalesce(amount >= 1000, false) then 'amount_range' end,
  case when not coalesce(label between 0 and 1, false) then 'label_flag' end,
  case when not coalesce(os in ('F', 'O'), false) then 'os_known' end) as violations from tx) where violations <> ''""")


def validated_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict load of one table, with a column dropped on the way, folded to comparable sums."""
    path = f"{sf_dir}/events.parquet"
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = S.load_validated(spark, path, names, ("props",), "ts")
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


LOAD_SQL = """select event_type, count(*)::bigint as n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts,
  'event_id,ts,user_id,event_type,value' as columns from events group by 1"""


def coerced_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text timestamps, every seventh unreadable."""
    text = F.when(F.col("tx_id") % 7 == 0, F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = S.coerce_timestamp(tx_events(spark, sf_dir).select("tx_id", text.alias("ts")), "ts")
    return df.select("tx_id", F.unix_seconds("ts").alias("seconds"))


COERCED_SQL = over("tx_events", """
select tx_id, case when tx_id % 7 = 0 then null else floor(epoch_us(ts) / 1000000.0) end::bigint as seconds from tx""")


QUERIES = {
    "instant_features": instant_features,
    "amount_buckets": amount_buckets,
    "brand_rules": brand_rules,
    "top_n_bucket": top_n_bucket,
    "rule_score": rule_score,
    "risk_bands": risk_bands,
    "band_counts": band_counts,
    "history_defaults": history_defaults,
    "schema_check": schema_check,
    "row_constraints": row_constraints,
    "quarantine": quarantine,
    "validated_load": validated_load,
    "coerced_timestamps": coerced_timestamps,
}
ORACLES = {
    "instant_features": INSTANT_SQL,
    "amount_buckets": AMOUNT_SQL,
    "brand_rules": BRAND_SQL,
    "top_n_bucket": TOP_N_SQL,
    "rule_score": over("tx_events", f"select tx_id, {stable_sql(RULE_SQL)} as score from tx"),
    "risk_bands": BANDS_SQL,
    "band_counts": BAND_COUNTS_SQL,
    "history_defaults": DEFAULTS_SQL,
    "schema_check": SCHEMA_SQL,
    "row_constraints": CONSTRAINTS_SQL,
    "quarantine": QUARANTINE_SQL,
    "validated_load": LOAD_SQL,
    "coerced_timestamps": COERCED_SQL,
}
