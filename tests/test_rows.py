import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import rows as R
from ledgerlark.operators import encoding as E
from ledgerlark.plans.scoring import REQUEST_HISTORY, request_features
from ledgerlark.sources import transactions as S


def one(spark, value, fn, kind):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("amount, band", [
    (1000.0, "0-1k"), (1000.01, "1k-5k"), (0.0, "0-1k"), (100_000.0, "50k-100k"), (100_000.5, "100k+"), (-1.0, "nan"),
    (-0.5, "0-1k"), (19_541.77, "10k-25k"), (None, "nan"),
])
def test_amount_bucket(spark, amount, band):
    assert one(spark, amount, R.amount_bucket, "double") == band


@pytest.mark.parametrize("amount, cents", [(19_541.77, 77), (5.0, 0), (0.29, 29), (-1.25, 75), (1.005, 0)])
def test_amount_cents(spark, amount, cents):
    assert one(spark, amount, R.amount_cents, "double") == cents


@pytest.mark.parametrize("model, brand", [
    ("iPhone 13", "iPhone"), ("samsung SM-A405FN", "Samsung"), ("SM-G1", "Samsung"), ("Redmi 9", "Xiaomi"),
    ("mi 10", "Xiaomi"), ("mini", "Other"), (None, "Unknown"), ("", "Other"),
])
def test_brand(spark, model, brand):
    assert one(spark, model, R.device_brand, "string") == brand


def test_null_parts_become_text(spark):
    df = spark.createDataFrame([("IOS", 1), (None, None)], "os string, flag int")
    got = df.select(R.crossed(F.col("os"), F.col("flag")).alias("c")).collect()
    assert [r.c for r in got] == ["IOS_1", "None_None"]


def test_rule_score_is_capped(spark):
    cols = "l1h int, l8h int, os string, fr boolean, t string, s string, a double"
    df = spark.createDataFrame([(1, 1, "Android", True, "Eft", "P", 1e9), (0, 0, "IOS", False, "Fast", "B", 0.0),
                                (1, None, None, None, None, None, None)], cols)
    score = R.rule_score(R.RuleColumns("l1h", "l8h", "os", "fr", "t", "s", "a"))
    assert [r[0] for r in df.select(score).collect()] == pytest.approx([1.0, 0.0, 0.4])


def test_bands_at_the_edges(spark):
    df = spark.createDataFrame([(0.95,), (0.9499,), (0.5,), (0.1,)], "s double")
    got = R.add_bands(df, "s").collect()
    assert [r.risk_band for r in got] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert [r.threshold_used for r in got] == [0.95, 0.5, 0.5, 0.5]
    assert [r.action for r in got] == ["BLOCK_OR_STEP_UP", "MANUAL_REVIEW", "MANUAL_REVIEW", "ALLOW"]


def test_top_levels_count_missing_values(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("b",), ("c",)], "m string")
    top = E.fit_top_levels(df, "m", 2)
    assert [r.level for r in top.collect()] == [None, "a"]
    got = sorted(str(r.m) for r in E.apply_top_levels(df, "m", top).collect())
    assert got == ["None", "None", "_OTHER_", "_OTHER_", "a", "a"]


REQUEST = dict(
    BusinessKey="k", AccountNumber=1, TransactionType="Fast", ReceiverName="r", SenderName="s", HasMobileActivationL1H=0,
    HasMobileActivationL8H=1, DayType=None, CustomerName="c", CustomerSegment="B", CustomerAge=40, CustomerTenure=2.0,
    CustomerEducation=None, CustomerProfession=None, CustomerMaritalStatus=None, CustomerGender="Erkek",
    IsFractionalAmount=True, TransactionAmount=19541.77, DeviceModel="iPhone 13", DeviceOSName="IOS", DeviceId="d",
    IP_Subnet="i", UniqueIPCount=3,
)


def requests(spark, *changes):
    import datetime

    base = {**REQUEST, "TransactionDate": datetime.datetime(2024, 6, 8, 13, 5), "historical_features": {"device_tx_count_7d": 4.0}}
    names = S.SCORE_REQUEST.names
    return spark.createDataFrame([tuple({**base, **c}[n] for n in names) for c in (changes or ({},))], S.SCORE_REQUEST)


def test_request_features(spark):
    top = spark.createDataFrame([("SM-G1",)], "level string")
    row = request_features(requests(spark), 0.006, top).first()
    assert len(REQUEST_HISTORY) == 33
    assert row.device_tx_count_7d == 4.0 and row.receiver_tx_count_7d == 0.0
    assert row.device_amount_ratio_to_mean == 1.0 and row.receiver_fraud_rate_smoothed == 0.006
    assert (row.hour, row.dow, row.is_weekend, row.is_holiday) == (13, 5, 1, 0)
    assert (row.DeviceModel, row.DeviceParentBrand, row.amount_cents) == ("_OTHER_", "iPhone", 77)


def test_feature_columns(spark):
    rows = requests(spark).withColumn("IsFraudTransaction", F.lit(0))
    df = request_features(rows, 0.0)
    num, text = R.feature_columns(df, S.COLUMN_ROLES)
    free_num, free_text = R.feature_columns(df, S.COLUMN_ROLES, drop_demographic=True)
    assert len(num) + len(text) == 60
    assert len(free_num) + len(free_text) == 56
    assert "CustomerAge" in num and "CustomerAge" not in free_num and "DayType" not in num + text


def test_request_rules(spark):
    bad = ({}, {"TransactionType": "Swift"}, {"CustomerAge": 121}, {"TransactionAmount": -1.0}, {"DeviceId": None}, {"HasMobileActivationL1H": 2})
    rules = S.transaction_rules(with_label=False)
    good, quarantined = S.split_valid(requests(spark, *bad), rules)
    assert good.count() == 1
    assert sorted(v for r in quarantined.collect() for v in r.violations) == [
        "CustomerAge_range", "DeviceId_present", "HasMobileActivationL1H_flag", "TransactionAmount_range", "TransactionType_known",
    ]
    counts = {r.rule: r.n_broken for r in S.violation_counts(requests(spark, *bad), rules).collect()}
    assert counts["CustomerAge_range"] == 1 and counts["CustomerTenure_range"] == 0


def test_schema_contract(spark, tmp_path):
    from ledgerlark.operators.profile import type_composition

    df = spark.createDataFrame([], S.TRANSACTIONS)
    path = str(tmp_path / "t")
    df.write.parquet(path)
    loaded = S.load_validated(spark, path)
    assert len(loaded.columns) == 25 and "TransactionChannel" not in loaded.columns
    assert S.check_schema(df).first().ok
    assert S.type_differences(df) == []
    assert sum(r.n_columns for r in type_composition(df).collect()) == 26
    wrong = str(tmp_path / "w")
    df.drop("DeviceId").withColumn("more", F.lit(1)).withColumn("UniqueIPCount", F.lit("x")).write.parquet(wrong)
    with pytest.raises(S.SchemaMismatch, match="DeviceId.*more"):
        S.load_validated(spark, wrong)
    assert S.type_differences(S.read_table(spark, wrong)) == ["UniqueIPCount: string, int"]


def test_parameter_files(spark, tmp_path):
    S.save_parameters(spark, {"best_model": "m", "HIGH": 0.9, "MEDIUM": 0.1}, str(tmp_path / "p"))
    assert S.load_parameters(spark, str(tmp_path / "p")) == {"best_model": "m", "HIGH": 0.9, "MEDIUM": 0.1}
