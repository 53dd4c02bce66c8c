"""Rows in a global order, cut into bounded blocks that carry what they need over their borders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.session import pin

_POSITION_BITS = 33


def in_blocks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``_seq`` (position in the order, with gaps) and ``_block`` (its range partition), and pin.

    The order must end in a column that parts equal rows; then even a run of one key is cut into blocks
    of about the same size.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id())
    return pin(ranged.withColumn("_block", F.shiftright("_seq", _POSITION_BITS)))
