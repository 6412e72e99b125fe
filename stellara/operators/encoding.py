"""Order-preserving dictionaries, code widths, packed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellara.session import cut


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(code, value): codes 0, 1, ... in the order of the distinct values; nulls have none.

    Values are dealt by range, and each range is numbered from the count of those before it.
    """
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(values.repartitionByRange(n, "value").withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select(F.col("range").alias("__range"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("value")))
    return ranked.join(F.broadcast(firsts), F.col("range") == F.col("__range")).select((F.col("first") + F.col("rank") - 1).alias("code"), "value")


def encode(df: DataFrame, column: str, codes: DataFrame, to: str) -> DataFrame:
    """Add the code of a column; values that the dictionary lacks get none."""
    held = codes.select(F.col("value").alias("__value"), F.col("code").alias(to))
    return df.join(held, F.col(column) == F.col("__value"), "left").drop("__value")


def decode(df: DataFrame, column: str, codes: DataFrame, to: str) -> DataFrame:
    held = codes.select(F.col("code").alias("__code"), F.col("value").alias(to))
    return df.join(held, F.col(column) == F.col("__code"), "left").drop("__code")


def width(n: Column) -> Column:
    """Bits of a code of n distinct values."""
    return F.when(n <= 128, 8).when(n <= 32768, 16).otherwise(32)


def widths(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_distinct, bits) in one pass."""
    counted = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    long = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct")) for c in columns])).alias("x")).select("x.*")
    return long.withColumn("bits", width(F.col("n_distinct")))


def halves(code: str) -> tuple[Column, Column]:
    """High and low 16 bits of a code."""
    return F.shiftright(F.col(code), 16).alias("hi"), F.col(code).bitwiseAND(65535).alias("lo")


def packed(df: DataFrame, row: str, code: str, bits: int) -> DataFrame:
    """(word_id, word): codes packed from the most significant bit on, 64 / bits to a word; the first bit of each is 0."""
    per = 64 // bits
    spot = F.lit(64 - bits) - (F.col(row) % per).cast("int") * bits
    return df.groupBy(F.expr(f"{row} div {per}").alias("word_id")).agg(F.bit_or(F.call_function("shiftleft", F.col(code).cast("long"), spot)).alias("word"))


def composite(keys: list[tuple[str, int]]) -> Column:
    """A mixed-radix number of codes, each with its count of distinct values."""
    out = F.lit(0).cast("long")
    for code, n in keys:
        out = out * n + F.col(code)
    return out
