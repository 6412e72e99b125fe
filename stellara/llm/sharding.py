"""Weighted rendezvous hashing of stable record keys over shards, in DataFrame functions only.

Law: `key`. Each (record key, shard) pair draws an exponential time, its rate the shard's weight,
from XXH64 of the pair; the earliest shard takes the record. Another shard only adds one more time to
each record's race, so a record either stays or goes to the new shard.

Defined cases: a null key is a key like any other (all such rows share a shard); rows that repeat a
key share its shard and get different slots; an empty table gives an empty result; other columns of
the input are left alone, whatever their names, but one called like a result is replaced; a null text has no bytes (size 16, CRC-32 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellara.llm.common import folded, table, unfolded

SHARDS = 40
OVERHEAD = 16
SLOT_ROWS = 4096


def times(key: Column, weights: Sequence[float]) -> Column:
    """Array of (time, shard), one for each shard."""
    w = F.array(*[F.lit(float(x)) for x in weights])

    def one(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.get(w, s)).alias("t"), s.alias("s"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), one)


def place(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Add `shard` and, with a weight for one more shard, `grown`: where the row goes with that shard too."""
    n = len(weights)
    if n < 1 or min(weights) <= 0:
        raise ValueError("weights: one positive number for each shard")
    made = [shard, *([grown] if grown_weight else [])]
    run = folded(df, *made, times=times(F.col(key), [*weights, *([grown_weight] if grown_weight else [])]))
    results = [F.array_min(F.slice("times", 1, n))["s"], F.array_min("times")["s"]]
    return unfolded(run, df, *made, **dict(zip(made, results, strict=False)))


def slotted(df: DataFrame, key: str, order: Sequence[str], n_rows: int, n_shards: int, shard: str = "shard", slot: str = "slot", times: str | None = None) -> DataFrame:
    """Number each shard's rows 0, 1, ... without gaps, no task holding a whole shard.

    Rows hash by key and order columns into buckets of about SLOT_ROWS rows of a shard; counts of (shard, bucket) give
    each bucket's first slot, and only buckets are sorted. With `times`, a column that counts how often a row
    stands for itself, rows that are alike come once, get that many slots and leave without the column.
    """
    n = 1 + n_rows // (n_shards * SLOT_ROWS)
    gone = (slot, *([times] if times else []))
    places = [f"o{i}" for i in range(len(order))]
    dealt = folded(df, *gone, shard=F.col(shard), bucket=F.pmod(F.xxhash64(F.col(key), *order, F.lit("slot")), F.lit(n)).cast("int"), n=F.col(times) if times else F.lit(1).cast("long"), **dict(zip(places, map(F.col, order), strict=True)))
    counts = dealt.groupBy(F.col("shard").alias("s"), F.col("bucket").alias("b")).agg(F.sum("n").alias("all"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("s", "b", F.coalesce(F.sum("all").over(before(Window.partitionBy("s").orderBy("b"))), F.lit(0)).alias("first"))
    ranked = dealt.withColumn("rank", F.coalesce(F.sum("n").over(before(Window.partitionBy("shard", "bucket").orderBy(*places))), F.lit(0)))
    out = ranked.join(firsts, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("at", F.col("first") + F.col("rank"))
    if times:
        out = out.withColumn("at", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))
    return unfolded(out, df, *gone, **{slot: F.col("at")})


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))
    placed = place(alike, "doc_id", [1.0] * SHARDS, 1.0)
    out = slotted(placed, "doc_id", ["doc_id", "text_crc32", "size"], docs.count(), SHARDS, times="times")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
