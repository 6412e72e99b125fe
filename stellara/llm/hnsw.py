"""Embedding near-duplicates: a hierarchical navigable small-world graph for each shard, every shard searched.

Exact copies of a vector are one class with a weight and a number. Classes are hashed to shards; a task builds a shard's
graph: upper layers from exact neighbours, the lowest by batches of insertions that search what is there,
choosing neighbours that are nearer to the new vector than to each other, and linking back. An audit then fixes the
graph's beam: queries are planted at the threshold's distance from vectors of the shard, and vectors with links are drawn;
the beam is widened until RECALL of both are found, at last comparing everything.

Every class is searched in every shard. Graphs come to the classes, not classes to the graphs: as many graphs as
WAVE_BYTES hold are broadcast, the classes stream past them, and the next wave follows; nothing is shuffled for the search.
A beam whose worst entry is still within the threshold is widened four times and the search repeated. Cosines are verified
in double precision. A class with up to FEW links in a shard gives them as pairs, so that a link that is found
from one end counts at both; one with more gives its number of links, and a forest instead of pairs.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, have no links and are their
own component; vectors of different lengths are never compared; equal vectors link (if valid); rows that repeat a
vec_id, or have none, count as vectors of their own; a component without any vec_id has none; an empty table gives an empty
result; other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellara.llm.common import cut, join_classes, partitions, ship, table
from stellara.llm.components import components
from stellara.llm.simhash import Forest

THRESHOLD = 0.9
#: Shards at least; bytes of a shard's vectors, and of the graphs that are broadcast at once, at most.
SHARDS, SHARD_BYTES, WAVE_BYTES = 8, 32 << 20, 64 << 20
DEGREE, UPPER, REACH = 24, 12, 40
BATCH, BEAM = 512, 16
AUDIT, RECALL = 256, 0.98
SLACK, MARGIN = 1e-5, 1e-3
#: Links of a class in a shard that are given as pairs; cosines that are held at once.
FEW, HELD = 16, 1 << 22


def normalised(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision; scaled first, for squares neither to vanish nor to overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose(x: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of candidates sorted by nearness (-1: none), up to `degree`: first those nearer to the row than to any chosen one."""
    vectors, valid = x[near], near >= 0
    pair = vectors @ vectors.transpose(0, 2, 1)
    kept, count, worst = np.zeros_like(valid), np.zeros(len(near), int), np.full(near.shape, -2, np.float32)
    for c in range(near.shape[1]):
        ok = valid[:, c] & (count < degree) & (sims[:, c] > worst[:, c])
        kept[:, c] = ok
        count += ok
        worst[ok] = np.maximum(worst[ok], pair[ok, c])
    for c in range(near.shape[1]):
        more = valid[:, c] & ~kept[:, c] & (count < degree)
        kept[:, c] |= more
        count += more
    order = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(kept, order, 1), np.take_along_axis(near, order, 1), -1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1).astype(np.int32)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest rows that a beam search from `start` meets: (rows, cosines), best first, -1 where there are no more."""
    n = len(q)
    width = max(width, start.shape[1])
    seen = np.zeros((n, len(x)), bool)
    rows, sims, fresh = np.full((n, width), -1), np.full((n, width), -2, np.float32), np.zeros((n, width), bool)
    k = start.shape[1]
    rows[:, :k], fresh[:, :k] = start, start >= 0
    sims[:, :k] = np.where(start >= 0, np.einsum("ad,amd->am", q, x[start]), -2)
    seen[np.arange(n)[:, None], np.where(start >= 0, start, start[:, :1])] = True
    at = np.arange(n)
    while len(at):
        best = np.where(fresh[at], sims[at], -3)
        top = best.argmax(axis=1)
        on = best[np.arange(len(at)), top] > -2
        at, top = at[on], top[on]
        if not len(at):
            break
        fresh[at, top] = False
        here = rows[at, top]
        around = links[here]
        new = (around >= 0) & ~seen[at[:, None], around]
        seen[at[:, None], np.where(around >= 0, around, here[:, None])] = True
        near = np.where(new, np.einsum("ad,amd->am", q[at], x[around]), -2)
        all_rows, all_sims, all_fresh = np.concatenate((rows[at], around), 1), np.concatenate((sims[at], near), 1), np.concatenate((fresh[at], new), 1)
        held = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        rows[at], sims[at], fresh[at] = np.take_along_axis(all_rows, held, 1), np.take_along_axis(all_sims, held, 1), np.take_along_axis(all_fresh, held, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = np.take_along_axis(sims, order, 1)
    return np.where(sims > -2, np.take_along_axis(rows, order, 1), -1), sims


class Graph:
    """Rows x (unit, single precision); layers: links of each row, the lowest first; entry: a row of the top layer."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 1) -> Graph:
        n = len(x)
        height = np.floor(-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / math.log(UPPER)).astype(int)
        height = np.minimum(height, max(0, math.floor(math.log(max(n, 1), UPPER)) - 1))
        graph = cls(x, [], int(height.argmax()) if n else 0)
        for layer in range(int(height.max(initial=0)), 0, -1):
            links = np.full((n, UPPER), -1, np.int32)
            graph.join_exactly(links, np.flatnonzero(height >= layer))
            graph.layers.insert(0, links)
        links = np.full((n, DEGREE), -1, np.int32)
        first = np.flatnonzero(height >= 1) if height.max(initial=0) else np.arange(min(n, 64))
        graph.join_exactly(links, first)
        rest, done = np.setdiff1d(np.random.default_rng(seed + 1).permutation(n), first, assume_unique=True), len(first)
        while len(rest):
            own, rest = rest[: min(BATCH, done)], rest[min(BATCH, done) :]
            graph.insert(links, own)
            done += len(own)
        graph.layers.insert(0, links)
        return graph

    def join_exactly(self, links: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(rows), BATCH):
            own = rows[at : at + BATCH]
            sims = self.x[own] @ self.x[rows].T
            sims[np.arange(len(own)), np.arange(at, at + len(own))] = -2
            self.attach(links, own, *best_of(rows[None, :].repeat(len(own), 0), sims, REACH))

    def insert(self, links: np.ndarray, own: np.ndarray) -> None:
        q = self.x[own]
        rows, sims = beam(self.x, links, q, self.descend(q), REACH)
        among = q @ q.T
        np.fill_diagonal(among, -2)
        self.attach(links, own, *best_of(np.concatenate((rows, own[None, :].repeat(len(own), 0)), 1), np.concatenate((sims, among), 1), REACH))

    def attach(self, links: np.ndarray, own: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        """Link rows to chosen candidates and back, choosing anew where a row gets too many links."""
        degree = links.shape[1]
        links[own] = choose(self.x, near, sims, degree)
        source = own.repeat(degree)
        target = links[own].ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.lexsort((-np.einsum("ad,ad->a", self.x[source], self.x[target]), target))
        source, target = source[order], target[order]
        begin = np.flatnonzero(np.diff(target, prepend=-1))
        rank = np.arange(len(target)) - np.repeat(begin, np.diff(np.append(begin, len(target))))
        source, target, rank = source[rank < REACH], target[rank < REACH], rank[rank < REACH]
        hit, inverse = np.unique(target, return_inverse=True)
        both = np.full((len(hit), degree + REACH), -1)
        both[:, :degree] = links[hit]
        both[inverse, degree + rank] = source
        both[:, degree:][(both[:, degree:, None] == both[:, None, :degree]).any(axis=2)] = -1
        cosines = np.where(both >= 0, np.einsum("ad,amd->am", self.x[hit], self.x[both]), -2)
        links[hit] = choose(self.x, *best_of(both, cosines, REACH), degree)

    def descend(self, q: np.ndarray) -> np.ndarray:
        """Where to start in the lowest layer."""
        start = np.full((len(q), 1), self.entry)
        for links in reversed(self.layers if len(self.layers) and self.layers[0].shape[1] == UPPER else self.layers[1:]):
            rows, _ = beam(self.x, links, q, start[:, :4], 8)
            start = rows
        return start[:, :4]

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width >= len(self.x) // 2:
            sims = q @ self.x.T
            return np.arange(len(self.x))[None, :].repeat(len(q), 0), sims
        return beam(self.x, self.layers[0], q, self.descend(q), width)

    def within(self, q: np.ndarray, least: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of all that is found at `least` or above, some queries at a time, beams being widened while they hold nothing else."""
        size = max(8, HELD // max(len(self.x), 1))
        todo = [(np.arange(len(q))[i : i + size], width) for i in range(0, len(q), size)]
        while todo:
            own, wide = todo.pop()
            rows, sims = self.search(q[own], wide)
            hit = (sims >= least) & (rows >= 0)
            full = hit.all(axis=1) & (rows.shape[1] < len(self.x))
            if full.any():
                todo.append((own[full], wide * 4))
            a, b = np.nonzero(hit & ~full[:, None])
            if len(a):
                yield own[a], rows[a, b]

    def audit(self, least: float, seed: int = 1) -> int:
        """The first beam width that finds RECALL of planted queries' vectors and of drawn vectors' links."""
        rng, n = np.random.default_rng(seed), len(self.x)
        own = rng.permutation(n)[:AUDIT]
        x = self.x[own]
        away = rng.normal(size=x.shape).astype(np.float32)
        away -= np.einsum("ad,ad->a", away, x)[:, None] * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-9)
        cosine = min(least + MARGIN, 1.0)
        planted = cosine * x + math.sqrt(1 - cosine * cosine) * away
        links = int((x @ self.x.T >= least).sum())
        width = BEAM
        while width < n // 2:
            rows, sims = self.search(planted, width)
            met = (rows == own[:, None]).any(axis=1) | (sims >= least).all(axis=1)  # a beam of links only is widened anyway
            if met.mean() >= RECALL and sum(len(a) for a, _ in self.within(x, least, width)) >= RECALL * links:
                break
            width *= 2
        return width

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, **{f"layer{i}": links for i, links in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes, x: np.ndarray) -> Graph:
        z = np.load(io.BytesIO(data))
        return cls(x, [z[f"layer{i}"] for i in range(len(z.files) - 1)], int(z["entry"]))


def best_of(rows: np.ndarray, sims: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if rows.shape[1] > n:
        held = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        rows, sims = np.take_along_axis(rows, held, 1), np.take_along_axis(sims, held, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    rows, sims = np.take_along_axis(rows, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -2, rows, -1), sims


def _array(e: Column) -> Column:
    return F.transform(e, lambda x: x.cast("double") + F.lit(0.0))


def valid(e: Column) -> Column:
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect, one for each node at most: least labels spread until none changes."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        now = label.copy()
        np.minimum.at(now, left, low)
        np.minimum.at(now, right, low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


#: What a row of search results is: a pair of links, a number of links, a link of a forest.
PAIR, COUNT, TREE = range(3)
_RESULT = "kind int, a long, b long, shard int, wa long, wb long"


class Shard:
    def __init__(self, row: tuple):
        self.dim, self.shard, self.width = row[0], row[1], row[2]
        self.x = np.frombuffer(row[4], np.float64).reshape(-1, self.dim)
        self.nodes, self.weights = np.frombuffer(row[5], np.int64), np.frombuffer(row[6], np.int64)
        self.graph = Graph.unpack(row[3], self.x.astype(np.float32))

    def results(self, nodes: np.ndarray, weights: np.ndarray, shards: np.ndarray, q: np.ndarray, least: float, forest: Forest) -> Iterator[tuple]:
        for a, b in self.graph.within(q.astype(np.float32), least - SLACK, self.width):
            off = nodes[a] != self.nodes[b]
            a, b = a[off], b[off]
            sure = np.concatenate([np.einsum("ad,ad->a", q[a[i : i + 65536]], self.x[b[i : i + 65536]]) >= least for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            a, b = a[sure], b[sure]
            few = (np.bincount(a, minlength=len(nodes)) <= FEW)[a]
            if few.any():
                i, j = a[few], b[few]
                yield PAIR, nodes[i], self.nodes[j], shards[i], weights[i], self.weights[j]
            if not few.all():
                i, j = a[~few], b[~few]
                total = np.bincount(i, self.weights[j], len(nodes)).astype(np.int64)
                own = np.unique(i)
                yield COUNT, nodes[own], nodes[own], np.full(len(own), self.shard, np.int32), weights[own], total[own]
                for s, t in zip(*(x.tolist() for x in spanning(nodes[i], self.nodes[j])), strict=True):
                    forest.link(s, t)
                if forest.fresh:
                    s, t = np.array(forest.fresh, np.int64).T
                    forest.fresh = []
                    yield TREE, s, t, np.zeros(len(s), np.int32), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)


def search_results(classes: DataFrame, total_bytes: int, least: float) -> DataFrame:
    """What the searches of all classes(node, w, v) in all shards give."""
    spark = classes.sparkSession
    ship(spark)
    shards = max(SHARDS, math.ceil(total_bytes / SHARD_BYTES))
    dealt = classes.select("node", "w", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"))

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node")
        x = normalised(np.stack(own["v"].to_numpy()))
        graph = Graph.build(x.astype(np.float32))
        out = {"dim": own["dim"].iloc[0], "shard": own["shard"].iloc[0], "width": graph.audit(least), "graph": graph.pack(), "x": x.tobytes(), "nodes": own["node"].to_numpy(np.int64).tobytes(), "ws": own["w"].to_numpy(np.int64).tobytes()}
        return pd.DataFrame({k: [v] for k, v in out.items()})

    graphs = cut(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, width int, graph binary, x binary, nodes binary, ws binary"))
    sizes = graphs.select("dim", "shard", (F.length("graph") + F.length("x") + F.length("nodes") + F.length("ws")).alias("size")).collect()
    waves: list[list[tuple[int, int]]] = []
    room = 0
    for r in sorted(sizes):
        if r["size"] > room:
            waves.append([])
            room = max(WAVE_BYTES, r["size"])
        room -= r["size"]
        waves[-1].append((r["dim"], r["shard"]))
    out = spark.createDataFrame([], _RESULT)
    for wave in waves:
        chosen = F.lit(False)
        for dim, shard in wave:
            chosen = chosen | ((F.col("dim") == dim) & (F.col("shard") == shard))
        held = spark.sparkContext.broadcast([tuple(r) for r in graphs.where(chosen).collect()])

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            near, forest = [Shard(row) for row in held.value], Forest()
            for batch in batches:
                nodes, weights, shards, dims = (batch.column(i).to_numpy() for i in (0, 1, 4, 3))
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    q = normalised(batch.column(2).take(pa.array(own)).flatten().to_numpy().reshape(-1, dim))
                    for one in (g for g in near if g.dim == dim):
                        for kind, *columns in one.results(nodes[own], weights[own], shards[own], q, least, forest):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], ["kind", "a", "b", "shard", "wa", "wb"])

        out = out.unionByName(cut(dealt.mapInArrow(run, _RESULT)))
        held.destroy()
    return out


def link_counts(found: DataFrame) -> DataFrame:
    """node, links: pairs count at both ends, but not where an end has counted the other's shard by itself."""
    pairs, counts = found.where(F.col("kind") == PAIR), found.where(F.col("kind") == COUNT)
    there = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("wb").alias("w"))
    back = pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("wa").alias("w"), "shard").join(counts.select(F.col("a").alias("node"), "shard"), ["node", "shard"], "left_anti").drop("shard")
    each = there.unionByName(back.select("node", "other", "w")).distinct().select("node", "w")
    return each.unionByName(counts.select(F.col("a").alias("node"), F.col("wb").alias("w"))).groupBy("node").agg(F.sum("w").alias("links"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = THRESHOLD) -> DataFrame:
    """key, n_links and component (the smallest key that links lead to) of every row."""
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).alias("e"))
    good = rows.where(valid(F.col("e"))).select("id", _array(F.col("e")).alias("v"))
    merged = good.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w"))
    classes = cut(merged.repartition(partitions(vectors.sparkSession), "v").withColumn("node", F.monotonically_increasing_id()))
    size = classes.agg(F.sum(F.size("v") * F.lit(8) + F.lit(DEGREE * 4 + 16)).alias("bytes"), F.sum("w").alias("rows")).first()
    found = search_results(classes, size["bytes"] or 0, least)
    roots = components(found.where(F.col("kind") != COUNT)).select(F.col("node").alias("of"), "root")
    counts = link_counts(found).select(F.col("node").alias("from"), "links")
    told = classes.join(roots, F.col("node") == F.col("of"), "left").join(counts, F.col("node") == F.col("from"), "left")
    told = cut(told.select("v", "w", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    names = told.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "of")
    held = cut(told.join(names, F.col("root") == F.col("of")).select("v", "w", "n_links", "component"))
    linked = join_classes(good, held, "v", size["rows"] or 0, "w").select("id", "n_links", "component")
    alone = rows.where(~valid(F.col("e"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumnRenamed("id", key)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
