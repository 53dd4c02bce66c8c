"""The transactions table: schema, reading, checks, and the files of fitted artefacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The table contract, column by column.
TRANSACTIONS = T.StructType(
    [
        T.StructField("BusinessKey", T.StringType()),
        T.StructField("AccountNumber", T.LongType()),
        T.StructField("TransactionDate", T.TimestampType()),
        T.StructField("TransactionType", T.StringType()),
        T.StructField("TransactionChannel", T.StringType()),
        T.StructField("ReceiverName", T.StringType()),
        T.StructField("SenderName", T.StringType()),
        T.StructField("IsFraudTransaction", T.IntegerType()),
        T.StructField("HasMobileActivationL1H", T.IntegerType()),
        T.StructField("HasMobileActivationL8H", T.IntegerType()),
        T.StructField("DayType", T.StringType()),
        T.StructField("CustomerName", T.StringType()),
        T.StructField("CustomerSegment", T.StringType()),
        T.StructField("CustomerAge", T.IntegerType()),
        T.StructField("CustomerTenure", T.DoubleType()),
        T.StructField("CustomerEducation", T.StringType()),
        T.StructField("CustomerProfession", T.StringType()),
        T.StructField("CustomerMaritalStatus", T.StringType()),
        T.StructField("CustomerGender", T.StringType()),
        T.StructField("IsFractionalAmount", T.BooleanType()),
        T.StructField("TransactionAmount", T.DoubleType()),
        T.StructField("DeviceModel", T.StringType()),
        T.StructField("DeviceOSName", T.StringType()),
        T.StructField("DeviceId", T.StringType()),
        T.StructField("IP_Subnet", T.StringType()),
        T.StructField("UniqueIPCount", T.IntegerType()),
    ]
)
EXPECTED_COLUMNS = tuple(TRANSACTIONS.names)
#: What a column is for, where it is more than a feature.
COLUMN_ROLES = {
    "BusinessKey": "id", "TransactionDate": "time", "IsFraudTransaction": "label", "DayType": "raw",
    **{c: "key" for c in ("AccountNumber", "DeviceId", "ReceiverName", "SenderName", "CustomerName", "IP_Subnet")},
    **{f"Customer{c}": "demographic" for c in ("Age", "Gender", "Education", "MaritalStatus")},
}
ENTITY_COLUMNS = tuple(c for c, role in COLUMN_ROLES.items() if role == "key")
DROP_ON_LOAD = ("TransactionChannel",)

SCORE_REQUEST = T.StructType(
    [f for f in TRANSACTIONS.fields if f.name not in ("TransactionChannel", "IsFraudTransaction")]
    + [T.StructField("historical_features", T.MapType(T.StringType(), T.DoubleType()))]
)


class SchemaMismatch(ValueError):
    """The table does not have exactly the expected columns."""


def coerce_timestamp(df: DataFrame, ts: str) -> DataFrame:
    """Text timestamps become timestamps; what cannot be read becomes null."""
    if isinstance(df.schema[ts].dataType, T.StringType):
        return df.withColumn(ts, F.try_to_timestamp(F.col(ts)))
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def read_table(spark: SparkSession, path: str, ts: str = "TransactionDate") -> DataFrame:
    """Parquet in, timestamp coerced; columns and filters are pruned at the scan as usual."""
    df = spark.read.parquet(path)
    return coerce_timestamp(df, ts) if ts in df.columns else df


def column_differences(df: DataFrame, expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) column names."""
    return [c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected]


def type_differences(df: DataFrame, expected: T.StructType = TRANSACTIONS) -> list[str]:
    """Columns whose type is not the expected one, as ``name: found, expected``."""
    found = {f.name: f.dataType for f in df.schema.fields}
    return [
        f"{f.name}: {found[f.name].simpleString()}, {f.dataType.simpleString()}"
        for f in expected.fields
        if f.name in found and found[f.name] != f.dataType
    ]


def check_schema(df: DataFrame, expected: Sequence[str] = EXPECTED_COLUMNS) -> DataFrame:
    """One row: ok, missing, extra, n_rows, n_cols."""
    missing, extra = column_differences(df, expected)

    def names(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(not missing and not extra).alias("ok"),
        names(missing).alias("missing"),
        names(extra).alias("extra"),
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
    )


def load_validated(
    spark: SparkSession,
    path: str,
    expected: Sequence[str] = EXPECTED_COLUMNS,
    drop: Sequence[str] = DROP_ON_LOAD,
    ts: str = "TransactionDate",
) -> DataFrame:
    """Read, refuse a wrong set of columns, drop the columns without signal.

    No global sort: every operator that needs order carries it in its own windows.
    """
    df = read_table(spark, path, ts)
    missing, extra = column_differences(df, expected)
    if missing or extra:
        raise SchemaMismatch(f"missing columns {missing}, extra columns {extra}")
    return df.drop(*[c for c in drop if c in df.columns])


# -- row constraints -------------------------------------------------------------------------------


def transaction_rules(with_label: bool = True) -> dict[str, Column]:
    """Rule name -> condition a good row fulfils."""
    c = F.col
    nullable = ("DayType", "CustomerEducation", "CustomerProfession", "CustomerMaritalStatus", "TransactionChannel")
    required = [n for n in EXPECTED_COLUMNS if n not in nullable and (with_label or n != "IsFraudTransaction")]
    rules = {f"{n}_present": c(n).isNotNull() for n in required}
    rules.update(
        TransactionType_known=c("TransactionType").isin("Fast", "Havale", "Eft"),
        HasMobileActivationL1H_flag=c("HasMobileActivationL1H").between(0, 1),
        HasMobileActivationL8H_flag=c("HasMobileActivationL8H").between(0, 1),
        CustomerAge_range=c("CustomerAge").between(0, 120),
        CustomerTenure_range=c("CustomerTenure") >= 0,
        TransactionAmount_range=c("TransactionAmount") >= 0,
        UniqueIPCount_range=c("UniqueIPCount") >= 0,
    )
    if with_label:
        rules["IsFraudTransaction_flag"] = c("IsFraudTransaction").between(0, 1)
    return rules


def check_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``violations``, the names of the rules a row breaks (empty for a good row)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    checked = check_rows(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows checked and rows broken for every rule, in one pass."""
    n_broken = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *n_broken)
    return wide.unpivot(["n_rows"], list(rules), "rule", "n_broken").select("rule", "n_rows", "n_broken")


# -- sinks and artefacts ---------------------------------------------------------------------------


def write_features(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",)) -> None:
    """The feature table, written once and then read by every fit and metric."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_parameters(spark: SparkSession, values: Mapping[str, float | str | int], path: str) -> None:
    """Cut-offs or tuned parameters as a one-row JSON table."""
    spark.createDataFrame([dict(values)]).coalesce(1).write.mode("overwrite").json(path)


def load_parameters(spark: SparkSession, path: str) -> dict:
    row = spark.read.json(path).first()
    return row.asDict() if row else {}
