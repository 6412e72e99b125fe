"""Bounded samples of documents for fitting classifiers, and the folds kept out of them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of UTF-8 text that a sample has at most; rows beyond it, by hashed id, are left out.
SAMPLE_BYTES = 48 << 20


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text, modulo folds, is the fold; a null key is held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def texts_of(docs: DataFrame, chosen: DataFrame, limit: int) -> list[tuple[int, int, str]]:
    """(id, y, text) of the chosen (id, y) in the order of ids, up to `limit` bytes in the order of hashed ids. A repeated id
    has one text, that of least hash; a null text is empty. Lengths come first: no more than that many bytes leave the executors."""
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = own.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), F.octet_length("text").alias("size"))).alias("one"))
    rows = found.select("id", "y", "one.mark", "one.size", F.xxhash64("id").alias("turn")).collect()
    kept, total = [], 0
    for r in sorted(rows, key=lambda r: (r["turn"], r["id"])):
        if total + r["size"] <= limit:
            total += r["size"]
            kept.append((r["id"], r["y"], r["mark"]))
    if not kept:
        return []
    wanted = docs.sparkSession.createDataFrame(kept, "id long, y int, mark long")
    got = own.withColumn("mark", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "mark"]).select("id", "y", "text").dropDuplicates(["id"]).collect()
    return sorted((r["id"], r["y"], r["text"]) for r in got)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, sizes: tuple[int, int], limit: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, float]:
    """(texts, labels, log odds of label 1): for each label the sizes[label] rows of least hashed id outside the fold.

    Only that many ids, and texts of `limit` bytes, come to the driver. Null labels and ids aren't used; a repeated
    doc_id counts once, by its least label and the text of least hash; a null text is empty.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    rows = usable.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    chosen = None
    for y, n in enumerate(sizes):
        some = rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    got = texts_of(docs, chosen, limit)
    odds = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    return [t for _, _, t in got], np.array([y for _, y, _ in got], dtype=np.float32), odds


def unlabelled(docs: DataFrame, folds: int, fold: int, size: int, limit: int = SAMPLE_BYTES) -> list[str]:
    """Texts of the `size` documents of least hashed id outside the fold, whether they have labels or not."""
    ids = docs.select(F.col("doc_id").alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id"), folds, fold))
    chosen = ids.distinct().orderBy(F.xxhash64("id"), "id").limit(size).withColumn("y", F.lit(-1))
    return [t for _, _, t in texts_of(docs, chosen, limit)]
