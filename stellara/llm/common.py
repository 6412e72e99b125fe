"""What the corpus operators share: table access, shipping, checkpoints, bounded broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellara.session import cut, remove, shared_folder

__all__ = ["cut", "folded", "free", "join_classes", "join_small", "partitions", "remove", "shared_folder", "ship", "table", "ticked", "unfolded", "unit"]

#: A side of at most this many short rows may be broadcast; beyond it, joins are salted.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors this package by Spark's own file server, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_stellara_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / "stellara_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._stellara_shipped = True


def ticked(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def folded(df: DataFrame, *without: str, **own: Column) -> DataFrame:
    """All columns of df, without some, as one struct `row`, and beside it columns of one's own, whose names can't clash."""
    kept = [F.col(ticked(c)) for c in df.columns if c not in without]
    return df.select((F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("none"))).alias("row"), *[c.alias(n) for n, c in own.items()])


def unfolded(df: DataFrame, like: DataFrame, *without: str, **more: Column) -> DataFrame:
    """The columns of the row again, in their order, and more after them."""
    return df.select(*[F.col(f"row.{ticked(c)}").alias(c) for c in like.columns if c not in without], *[c.alias(n) for n, c in more.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit(*parts: Column | str) -> Column:
    """A number in (0, 1) from the MD5 of the parts joined by ':', the same in any SQL engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def join_small(rows: DataFrame, small: DataFrame, key: str, n_small: int, spread: Column) -> DataFrame:
    """Left join on `key`, nulls matching nulls, where one key may hold most rows.

    `small` has one row a key. Up to BROADCAST_ROWS keys it is broadcast; beyond that both sides
    are salted: `spread` deals a key's rows over as many salts as there are shuffle partitions.
    """
    held = small.withColumnRenamed(key, "__key")
    if n_small <= BROADCAST_ROWS:
        return rows.join(F.broadcast(held), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    n = partitions(rows.sparkSession)
    salted = rows.withColumn("__salt", F.pmod(spread, F.lit(n)).cast("int"))
    held = held.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__salt2"))
    return salted.join(held, on, "left").drop("__key", "__salt", "__salt2")


def join_classes(rows: DataFrame, classes: DataFrame, key: str, n_rows: int, count: str, hot_share: int = 5000) -> DataFrame:
    """Inner join of rows with one row for each key, of which some hold very many rows.

    `classes` has (key, ..., count). Keys with over n_rows / hot_share rows are fewer than
    hot_share, so they are broadcast; the rest shuffles, no key of it being large.
    """
    limit = max(n_rows // hot_share, 1)
    hot = classes.where(F.col(count) > limit)
    marks = F.broadcast(hot.select(F.col(key).alias("__hot")))
    cold = rows.join(marks, F.col(key) == F.col("__hot"), "left_anti").join(classes.where(F.col(count) <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)
