"""Packed bitmaps over row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellara.functions.bits import bit_at, bit_of


def bitmap(df: DataFrame, row: str, holds: Column) -> DataFrame:
    """(word_id, word): the rows for which `holds` is true; a word of no such row is 0."""
    bit = F.when(holds, bit_of(F.col(row))).otherwise(F.lit(0).cast("long"))
    return df.groupBy(F.expr(f"{row} div 64").alias("word_id")).agg(F.bit_or(bit).alias("word"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both bitmaps hold."""
    other = b.select("word_id", F.col("word").alias("__word"))
    return a.join(other, "word_id").select("word_id", F.col("word").bitwiseAND(F.col("__word")).alias("word"))


def population(words: DataFrame) -> DataFrame:
    return words.agg(F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("long").alias("matches"))


def positions(words: DataFrame) -> DataFrame:
    """row_id of every set bit."""
    spots = words.where("word <> 0").withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return spots.where(bit_at(F.col("word"), F.col("position")) == 1).select((F.col("word_id") * 64 + F.col("position")).alias("row_id"))
