"""Trend alarms, shared neighbours, and a model in a stream."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerlark.catalog import model_queries as Q
from ledgerlark.operators import drift, graph
from ledgerlark.plans import scoring
from ledgerlark.plans import training as T
from ledgerlark.session import pin
from ledgerlark.sources import transactions as S
from ledgerlark.streaming import jobs


def test_trend_sums_equal_their_recursion_and_alarm_after_a_step(spark):
    rng = random.Random(2)
    rows = [(d, g, int(rng.random() < (0.1 if d < 20 or g == "flat" else 0.3 if g == "rises" else 0.01))) for d in range(40) for g in ("flat", "rises", "falls") for _ in range(60)]
    rows += [(3, None, 1), (None, "flat", 1), (5, "flat", None)]
    df = spark.createDataFrame(rows, "d int, g string, y int").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400 + 1_700_006_400))
    found = {}
    for r in drift.rate_trend(df, "ts", "y", "g", F.col("d") < 20).collect():
        found.setdefault(r["group"], []).append(r)
    assert set(found) == {"flat", "rises", "falls", "missing"} and len(found["missing"]) == 1
    for own in found.values():
        up = down = 0.0
        for r in sorted(own, key=lambda r: r["period"]):
            up = max(0.0, up + r["hits"] - r["n"] * r["expected"] * 1.1)
            down = max(0.0, down + r["n"] * r["expected"] * 0.9 - r["hits"])
            assert (r["up"], r["down"]) == (pytest.approx(up), pytest.approx(down))
    last = {g: max(own, key=lambda r: r["period"])["alarm"] for g, own in found.items()}
    assert (last["rises"], last["falls"]) == ("up", "down")
    assert not any(r["alarm"] for r in found["rises"] if r["up"] == 0 and r["down"] == 0)


@pytest.mark.parametrize("n, exact", [(300, True), (20_000, False)])
def test_shared_neighbours_around_a_hub(spark, n, exact):
    """One right node knows half of all left nodes; the rest form chains of three."""
    df = spark.range(n).select(F.col("id").alias("l"), F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.floor(F.col("id") / 6)).alias("r"))
    df = df.unionByName(df.where("l < 10")).unionByName(spark.createDataFrame([(None, 1), (1, None)], "l bigint, r bigint"))
    found = {r["l"]: r["shared_neighbours"] for r in graph.shared_neighbours(df, "l", "r").collect()}
    assert len(found) == n and found[1] == 2 and found[7] == 2
    hub = [found[i] for i in range(0, n, 2)]
    assert len(set(hub)) == 1 and (hub[0] == n // 2 - 1 if exact else abs(hub[0] / (n // 2 - 1) - 1) < 3 * 1.04 / 64)


def test_a_stream_scores_like_a_batch_and_reads_cutoffs_again(spark, tmp_path):
    table = pin(Q.feature_table(spark, SMALL))
    f = Q.features_of(table)
    model = T.fit(table.where("split = 'train'"), f, T.Model("logreg", "logreg", {"maxIter": 4, "C": 1.0}))
    test = table.where("split = 'test'")
    where = {k: str(tmp_path / k) for k in ("in", "cutoffs", "out", "checkpoint")}
    expected = {}
    for part, cut in enumerate(({"HIGH": 0.9, "MEDIUM": 0.6}, {"HIGH": 0.4, "MEDIUM": 0.2})):
        rows = test.where(F.col("tx_id") % 2 == part)
        rows.write.mode("append").parquet(where["in"])
        S.save_parameters(spark, cut, where["cutoffs"])
        stream = spark.readStream.schema(test.schema).parquet(where["in"])
        jobs.score_micro_batches(stream, model, f, where["cutoffs"], where["out"], where["checkpoint"]).awaitTermination()
        expected |= {r["tx_id"]: (r["fraud_score"], r["risk_band"]) for r in scoring.score(rows, model, f, cut).collect()}
    got = {r["tx_id"]: (r["fraud_score"], r["risk_band"]) for r in spark.read.parquet(where["out"]).collect()}
    assert got == expected and len(got) == test.count()
