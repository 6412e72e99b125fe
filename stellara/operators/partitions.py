"""Row-range partitions and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 64


def rounded(rows: int) -> int:
    """A partition's size: whole segments."""
    return -(-rows // SEGMENT) * SEGMENT


def morsels(df: DataFrame, row: str, rows: int) -> DataFrame:
    """(part_id, first_row, last_row, n_rows) of contiguous row ranges; the last may be short."""
    part = F.expr(f"{row} div {rounded(rows)}").alias("part_id")
    return df.groupBy(part).agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.count(F.lit(1)).alias("n_rows"))


def full_morsels(df: DataFrame, row: str, rows: int) -> DataFrame:
    """The same, without a short last range."""
    return morsels(df, row, rows).where(F.col("n_rows") == rounded(rows))


def range_of(column: str):
    """The 16-bit range partition of a value."""
    return F.shiftright(F.col(column), 16)
