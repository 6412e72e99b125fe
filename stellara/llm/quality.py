"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of WIDTH bytes read the document at every second byte, and their
rectified responses are averaged over chunks of two halves, each half shared by two chunks, so that
the chunks overlap and cover the whole document. Each filter's greatest chunk goes into one logistic unit.
It is fitted by Adam on a bounded sample of labelled documents (SAMPLE rows of each label, sample.SAMPLE_BYTES of text), and its bias
is moved from the sample's share of labels to that of all labelled rows outside the held-out fold.

Defined cases: null and empty texts are scored as padding only; texts of any length are read whole; rows
that repeat score alike; without labels of both kinds, every score is the share of label 1 (0.5 if there are none);
an empty table gives an empty result; other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stellara.llm.common import free, ship, table, ticked
from stellara.llm.sample import held_out, labelled

FOLDS, FOLD = 5, 0
#: Rows of label 0 and of label 1 to fit on, at most.
SAMPLE = (900, 1400)
EPOCHS, BATCH, RATE = 12, 16, 0.004
WIDTH, STEP, HALF = 8, 2, 64
DIM, FILTERS = 8, 32
PIECE = 1 << 20
THRESHOLD = 0.3


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    lift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.lift, self.out, self.bias]


def fresh(seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    f32 = lambda x: x.astype(np.float32)
    return Network(f32(rng.normal(0, 0.5, (256, DIM))), f32(rng.normal(0, 0.15, (WIDTH * DIM, FILTERS))), np.zeros(FILTERS, np.float32), f32(rng.normal(0, 0.3, FILTERS)), np.zeros(1, np.float32))


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text padded with WIDTH zeros or more to whole halves and followed by a half of zeros, so that
    no filter reads into the next text; and where each text's halves begin."""
    halves = np.array([(len(t) + WIDTH + HALF - 1) // HALF + 1 for t in texts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(halves)))
    flat = np.zeros(int(first[-1]) * HALF + WIDTH, np.uint8)
    for t, at in zip(texts, (first[:-1] * HALF).tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return flat, first


def responses(net: Network, flat: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Mean rectified response of each filter in each half. keep: gets what the gradient needs."""
    x = net.embed[flat]
    n = len(flat) - WIDTH
    total = np.zeros((n // HALF, FILTERS), np.float32)
    for shift in range(0, WIDTH, STEP):
        rows = x[shift : shift + n].reshape(-1, WIDTH * DIM)
        y = rows @ net.kernel
        y += net.lift
        np.maximum(y, 0, out=y)
        total += y.reshape(-1, HALF // WIDTH, FILTERS).sum(axis=1)
        if keep is not None:
            keep.append((shift, rows, y > 0))
    total /= HALF // STEP
    return total


def chunks(halves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row i: the mean of halves i and i + 1 of a text, or its only half; -1 where there is no chunk."""
    out = halves.copy()
    out[:-1] += halves[1:]
    out *= 0.5
    last = first[1:] - 1
    out[last] = -1.0
    out[last - 1] = np.where((np.diff(first) == 2)[:, None], halves[last - 1], -1.0)
    return out


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Logits of whole texts, worked off in pieces of about PIECE bytes; a longer text's halves are gathered from several."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        if end == at + 1 and len(texts[at]) > 2 * PIECE:
            flat, first = lay_out(texts[at:end])
            step = PIECE - PIECE % HALF
            halves = np.concatenate([responses(net, flat[i : i + step + WIDTH]) for i in range(0, len(flat) - WIDTH, step)])
            out[at] = chunks(halves, first).max(axis=0) @ net.out + net.bias[0]
        else:
            flat, first = lay_out(texts[at:end])
            pooled = np.maximum.reduceat(chunks(responses(net, flat), first), first[:-1], axis=0)
            out[at:end] = pooled @ net.out + net.bias[0]
        at = end
    return out


def gradients(net: Network, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    flat, first = lay_out(texts)
    keep: list = []
    chunked = chunks(responses(net, flat, keep), first)
    pooled = np.maximum.reduceat(chunked, first[:-1], axis=0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias[0], -60, 60)))
    d = ((p - y) / len(y)).astype(np.float32)
    d_pool = d[:, None] * net.out
    d_half = np.zeros_like(chunked)
    columns = np.arange(FILTERS)
    for k in range(len(texts)):
        a, b = int(first[k]), int(first[k + 1])
        top = a + chunked[a:b].argmax(axis=0)
        if b - a == 2:
            d_half[top, columns] += d_pool[k]
        else:
            d_half[top, columns] += 0.5 * d_pool[k]
            d_half[top + 1, columns] += 0.5 * d_pool[k]
    d_half /= HALF // STEP
    n = len(flat) - WIDTH
    d_kernel, d_lift, d_x = np.zeros_like(net.kernel), np.zeros_like(net.lift), np.zeros((len(flat), DIM), np.float32)
    for shift, rows, on in keep:
        d_y = (np.repeat(d_half, HALF // WIDTH, axis=0) * on).astype(np.float32)
        d_kernel += rows.T @ d_y
        d_lift += d_y.sum(axis=0)
        d_x[shift : shift + n] += (d_y @ net.kernel.T).reshape(-1, DIM)
    d_embed = np.stack([np.bincount(flat, d_x[:, j], 256) for j in range(DIM)], axis=1).astype(np.float32)
    return [d_embed, d_kernel, d_lift, pooled.T @ d, np.array([d.sum()], np.float32)]


def fit(texts: list[bytes], y: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> Network:
    net, rng, step = fresh(seed), np.random.default_rng(seed), 0
    mean, square = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for p, g, m, s in zip(net.parts(), gradients(net, [texts[i] for i in own], y[own]), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, fold: int = FOLD, sample: tuple[int, int] = SAMPLE) -> Network:
    texts, y, odds = labelled(docs, labels, label, folds, fold, sample)
    ones = float(y.sum())
    if not 0 < ones < len(y):
        net = fresh()
        net.out[:], net.bias[:] = 0, odds
        return net
    net = fit([t.encode() for t in texts], y)
    net.bias += np.float32(odds - math.log(ones / (len(y) - ones)))
    return net


def score(docs: DataFrame, net: Network, text: str = "text", column: str = "score") -> DataFrame:
    """The columns of `docs`, without `column` if they have it, and the probability of label 1 as `column`."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)
    kept = [c for c in docs.columns if c != column]
    own = docs.select(*map(ticked, kept), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias(free(docs, "bytes")))
    schema = StructType([*own.schema.fields[:-1], StructField(column, DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(scores(held.value, batch.column(len(kept)).to_pylist()), -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(p)], [*kept, column])

    return own.mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
