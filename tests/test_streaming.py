import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerlark.catalog.stream_queries import stream_pit
from ledgerlark.catalog.views import ROLES, tx_events
from ledgerlark.operators.history import DAY_US, Entity, LabelRate, add_history
from ledgerlark.session import scratch_folder
from ledgerlark.streaming.history import HistoryStream

ENTITIES = (
    Entity("device", "device", True, (1,), (("receivers", "receiver"),), True, True, True, True, (LabelRate(2),)),
    Entity("account", "account", True, gap=True),
)


def run(spark, df, chunks, delay_us, **kw):
    folder = scratch_folder(spark, "t")
    job = HistoryStream(ENTITIES, ROLES, 0.1, folder, delay_us, **kw)
    for i, part in enumerate(chunks):
        job.update(part, i)
    job.flush(spark)
    return job


def rounded(df):
    names = [c for c in df.columns if c.startswith(("device_", "account_"))]
    # the shift keeps exact halves on one side when the order of additions differs
    return df.select("tx_id", *[F.round(F.col(c).cast("double") + 1e-9, 5).alias(c) for c in names])


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_stream_equals_batch(spark, hot_rows):
    tx = tx_events(spark, SMALL)
    # a missing key, and rows that arrive up to four days after newer ones
    tx = tx.withColumn("device", F.when(F.col("tx_id") % 11 > 0, F.col("device")))
    day = F.floor(F.unix_micros("ts") / DAY_US) - 19723 + F.col("tx_id") % 4
    chunks = [tx.where(day < 12), tx.where((day >= 12) & (day < 22)), tx.where(day >= 22)]
    job = run(spark, tx, chunks, 5 * DAY_US, hot_rows=hot_rows, slice_us=8 * 3_600_000_000)
    got = rounded(job.features(spark)).cache()
    want = rounded(add_history(tx, ENTITIES, ROLES, 0.1)).cache()
    assert job.late_rows(spark) == 0
    assert got.count() == want.count() == tx.count()
    assert got.exceptAll(want).count() == 0


def test_repeated_batch_changes_nothing(spark):
    tx = tx_events(spark, SMALL)
    a, b = tx.where("ts < timestamp '2024-01-15'"), tx.where("ts >= timestamp '2024-01-15'")
    folder = scratch_folder(spark, "t")
    job = HistoryStream(ENTITIES, ROLES, 0.1, folder, 0)
    job.update(a, 0)
    job.update(b, 1)
    job.update(b, 1)
    job.flush(spark)
    want = rounded(add_history(tx, ENTITIES, ROLES, 0.1))
    assert rounded(job.features(spark)).exceptAll(want).count() == 0
    assert job.features(spark).count() == tx.count()


def test_rows_without_a_time_are_kept_aside(spark):
    tx = tx_events(spark, SMALL).where("ts < timestamp '2024-01-05'")
    broken = tx.withColumn("ts", F.expr("case when tx_id % 7 <> 0 then ts end"))
    job = run(spark, broken, [broken.where("tx_id % 2 = 0"), broken.where("tx_id % 2 = 1")], 40 * DAY_US)
    good = broken.where("ts is not null")
    assert job.features(spark).count() == good.count()
    assert sorted(r[0] for r in job.rejected_rows(spark).select("tx_id").collect()) == sorted(r[0] for r in tx.where("tx_id % 7 = 0").select("tx_id").collect())
    assert rounded(job.features(spark)).exceptAll(rounded(add_history(good, ENTITIES, ROLES, 0.1))).count() == 0


def test_late_rows_are_counted(spark):
    tx = tx_events(spark, SMALL)
    early, rest = tx.where("tx_id = 0"), tx.where("tx_id > 0")
    job = run(spark, tx, [rest, early], DAY_US)
    assert job.late_rows(spark) == 1
    assert job.features(spark).count() == tx.count() - 1


def test_state_grows_by_new_pairs_only(spark):
    tx = tx_events(spark, SMALL).where("ts < timestamp '2024-01-11'")
    folder = scratch_folder(spark, "t")
    job = HistoryStream(ENTITIES[:1], ROLES, 0.1, folder, 0)
    job.update(tx.where("ts < timestamp '2024-01-06'"), 0)
    job.update(tx.where("ts >= timestamp '2024-01-06'"), 1)
    pairs = [{tuple(r) for r in spark.read.parquet(f"{folder}/state/device_met_receivers/version={i}").select("_e_key", "_target").collect()} for i in range(2)]
    assert pairs[0] and pairs[1] and not pairs[0] & pairs[1]
    assert len(pairs[0] | pairs[1]) == tx.select("device", "receiver").distinct().count()


def test_no_row_is_late_however_the_events_lie_in_files(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.where("ts < timestamp '2024-01-16'").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    events.where("ts >= timestamp '2024-01-16'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert stream_pit(spark, str(tmp_path)).count() == events.count()
