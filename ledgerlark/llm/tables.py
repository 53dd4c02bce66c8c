"""Reading the text tables and keeping intermediate results in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.session import scratch_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Compressed and column-pruned, unlike a checkpoint of rows; survives lost executors alike.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_crc(column: str = "doc_id") -> Column:
    """CRC-32 of the id as text; the empty text for a null id."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; one light pass that sizes groups of rows by data volume."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count(F.lit(1))).first()[0]


def text_key(text: Column) -> Column:
    """64-bit hash that names a text among the rows of one id; null and empty texts differ."""
    return F.xxhash64(text.cast("string"), text.isNull())
