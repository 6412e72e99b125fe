"""The star written once as Parquet: a typed fact, by year, and its dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellara.schema import DIMENSIONS, FACT
from stellara.sources.views import FACT_COLUMNS, Star, Stored

YEAR = "order_year"


def write_star(star: Star, folder: str) -> None:
    """The one large join of line items and orders, paid once. Rows are dealt by year and line, so that a year is several files."""
    fact = star.lineorder(FACT_COLUMNS).withColumn(YEAR, F.floor(F.col("lo_orderdate") / 10_000).cast("int"))
    n = int(star.spark.conf.get("spark.sql.shuffle.partitions"))
    fact.repartition(n, YEAR, F.pmod(F.xxhash64("lo_orderkey"), F.lit(n))).sortWithinPartitions(YEAR, "lo_orderdate").write.mode("overwrite").partitionBy(YEAR).parquet(f"{folder}/{FACT}.parquet")
    for name in DIMENSIONS:
        star.view(name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def open_star(star: Star, folder: str) -> Star:
    """The same views from what write_star() wrote: filters reach the files' statistics, date filters their folders."""
    return Stored(star.spark, folder, YEAR)
