"""Streaming jobs run to the end of the event table, compared with the batch texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import EFT, RULES, over, scored_sql, stable
from ledgerlark.catalog.history_queries import PRIOR, _outputs, history_sql
from ledgerlark.catalog.views import ROLES, TX_EVENTS, table, tx_events
from ledgerlark.functions.rows import rule_score
from ledgerlark.operators.history import DAY_US, Entity, LabelRate
from ledgerlark.session import scratch_folder
from ledgerlark.streaming import jobs
from ledgerlark.streaming.history import HistoryStream

NOW = {"availableNow": True}


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = table(spark, sf_dir, "events").schema
    spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").createOrReplaceTempView("events")
    return spark.sql(TX_EVENTS)


def _closing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with a last row far in the future (tx_id -1), which moves the watermark past all others."""
    folder, events = scratch_folder(spark, "closing"), table(spark, sf_dir, "events")
    events.write.parquet(f"{folder}/events.parquet")
    last = events.limit(1).withColumns({"event_id": F.lit(-1).cast(events.schema["event_id"].dataType), "ts": F.lit("2100-01-01 00:00:00").cast(events.schema["ts"].dataType)})
    last.write.mode("append").parquet(f"{folder}/events.parquet")
    return _event_stream(spark, folder)


def _to_end(df: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything available and read what it wrote."""
    jobs.write_stream(df, f"{folder}/out", f"{folder}/checkpoint", **NOW).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _event_stream(spark, sf_dir)
    scored = jobs.score_stream(stream, stable(rule_score(RULES, EFT)), {"HIGH": 0.6, "MEDIUM": 0.35})
    out = _to_end(scored.select("tx_id", "fraud_score", "risk_band", "is_fraud", "action"), scratch_folder(spark, "score"))
    return out


SCORE_SQL = scored_sql("""
select tx_id, score as fraud_score, band as risk_band, band in ('HIGH', 'MEDIUM') as is_fraud,
  case band when 'HIGH' then 'BLOCK_OR_STEP_UP' when 'MEDIUM' then 'MANUAL_REVIEW' else 'ALLOW' end as action
from (select *, case when score >= 0.6 then 'HIGH' when score >= 0.35 then 'MEDIUM' else 'LOW' end as band from s)""")


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days, closed by the end of the stream."""
    daily = jobs.daily_volume(_closing_stream(spark, sf_dir), "ts", "label", "1 day", stable(rule_score(RULES, EFT)) >= 0.5)
    return _to_end(daily, scratch_folder(spark, "daily")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


DAILY_SQL = scored_sql("""
select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*)::bigint as n, sum(label)::bigint as n_positives,
  round(sum(label) / count(*) * 100, 4) as rate_pct, count(*) filter (score >= 0.5)::bigint as n_alerts
from s group by date_trunc('day', ts)""")

STREAMED = (
    Entity("device", "device", True, (1, 7), (("receivers", "receiver"),), True, True, True, True, (LabelRate(7),)),
    Entity("receiver", "receiver", True, (7,), (("devices", "device"),), rates=(LabelRate(2, window_days=7),)),
)


def stream_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History features from four micro-batches whose rows overlap in time by up to two days."""
    folder = scratch_folder(spark, "pit")
    tx = tx_events(spark, sf_dir)
    day = F.floor(F.unix_micros("ts") / DAY_US) - F.lit(19723)  # days since 2024-01-01
    chunk = F.least(F.floor((day + F.col("tx_id") % 3) / 8), F.lit(3))
    job = HistoryStream(STREAMED, ROLES, PRIOR, folder, 3 * DAY_US)
    # a part is one micro-batch however many files it has; split by files, rows of a part could come after its watermark
    for i in range(4):
        tx.where(chunk == i).write.parquet(f"{folder}/in/part={i}")
        stream = spark.readStream.schema(tx.schema).parquet(f"{folder}/in/part=*")
        job.start(stream, f"{folder}/checkpoint", **NOW).awaitTermination()
    job.flush(spark)
    out = job.features(spark)
    return _outputs(out, [c for c in out.columns if c not in tx.columns], STREAMED, 4)


def stream_late_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels arrive 0 to 9 days after their row; only those within 7 days count."""
    folder = scratch_folder(spark, "labels")
    stream = _closing_stream(spark, sf_dir)
    rows = stream.select("tx_id", "ts")
    known = F.timestamp_micros(F.unix_micros("ts") + (F.col("tx_id") % 10) * DAY_US)
    labels = stream.select("tx_id", known.alias("known_at"), "label")
    joined = jobs.join_late_labels(rows, labels, "tx_id", "ts", "known_at", "label")
    out = _to_end(joined.select("tx_id", "ts", "late_label"), folder)
    return out.where("tx_id >= 0").select("tx_id", F.col("late_label").cast("bigint").alias("late_label"))


LATE_SQL = over("tx_events", """
select tx_id, case when tx_id % 10 <= 7 then label end::bigint as late_label from tx""")

QUERIES = {f.__name__: f for f in (stream_score, stream_daily, stream_pit, stream_late_labels)}
ORACLES = {
    "stream_score": SCORE_SQL,
    "stream_daily": DAILY_SQL,
    "stream_pit": history_sql("tx_events", STREAMED),
    "stream_late_labels": LATE_SQL,
}
