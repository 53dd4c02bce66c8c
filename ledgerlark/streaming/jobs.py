"""Streaming scoring, daily volumes, and late labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.functions.rows import add_bands
from ledgerlark.plans.scoring import score
from ledgerlark.plans.training import Features, predict
from ledgerlark.sources.transactions import load_parameters


def score_stream(stream: DataFrame, scorer: Column | PipelineModel, cutoffs: Mapping[str, float] | None = None,
                 score: str = "fraud_score") -> DataFrame:
    """Score, band and action for each arriving row, by rules or by a fitted model; no state."""
    if isinstance(scorer, PipelineModel):
        scored = predict(scorer, stream, score)
    else:
        scored = stream.withColumn(score, scorer)
    return add_bands(scored, score, cutoffs)


def daily_volume(stream: DataFrame, ts: str, label: str, delay: str = "1 day", alert: Column | None = None) -> DataFrame:
    """Rows, positives, rate and alerts per day; a day is emitted once the watermark passes its end."""
    day = F.window(F.col(ts), "1 day")
    alerts = F.count_if(F.lit(False) if alert is None else alert)
    sums = stream.withWatermark(ts, delay).groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("n_positives"), alerts.alias("n_alerts")
    )
    rate = F.round(F.col("n_positives") / F.col("n") * 100, 4)
    return sums.select(F.to_date("day.start").alias("day"), "n", "n_positives", rate.alias("rate_pct"), "n_alerts")


def join_late_labels(rows: DataFrame, labels: DataFrame, row_id: str, ts: str, label_ts: str, label: str,
                     lag_days: int = 7, delay: str = "1 hour") -> DataFrame:
    """Each row with its label if that arrives within the lag, else with null.

    ``labels`` has the row id, the label and the time it became known. Both sides are bounded in time,
    so the state of rows older than the lag is released.
    """
    left = rows.withWatermark(ts, delay)
    right = labels.select(F.col(row_id).alias("_label_id"), F.col(label_ts).alias("_label_ts"), F.col(label).alias(f"late_{label}"))
    right = right.withWatermark("_label_ts", delay)
    in_time = (
        (F.col(row_id) == F.col("_label_id"))
        & (F.col("_label_ts") >= F.col(ts))
        & (F.col("_label_ts") <= F.col(ts) + F.expr(f"interval {lag_days} days"))
    )
    return left.join(right, in_time, "left_outer").drop("_label_id")


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    """Append to files; exactly once with the checkpoint."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def score_micro_batches(stream: DataFrame, model: PipelineModel, f: Features, cutoffs: str, path: str, checkpoint: str, model_version: str = "", **trigger) -> StreamingQuery:
    """Score each micro-batch with a fitted model and the cut-offs that ``cutoffs`` holds at that moment.

    A batch is written into a folder of its own, which a repeated batch overwrites.
    """

    def write(rows: DataFrame, batch: int) -> None:
        stored = load_parameters(rows.sparkSession, cutoffs)
        known = {k: float(stored[k]) for k in ("HIGH", "MEDIUM") if stored.get(k) is not None}
        score(rows, model, f, known, model_version).drop("reason_codes").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
