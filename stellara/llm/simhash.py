"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprint segments, joined and verified.

A fingerprint's 64 bits are three segments, each padded to the 23 bits of the binary Golay code. Two
segments at 2 or fewer differing bits have a word midway, which some codeword is within 3 bits of; so both
are within 4 bits of that codeword. With 4 or fewer differing bits in all, the two least differing segments
have 2 or fewer together: both share a codeword, and the pair of their 12-bit indices is a key that both
fingerprints have. Syndromes list the error patterns that lead to such codewords, 5.3 in the mean.

Distinct fingerprints are dealt by key and sorted; runs of a key are compared bit by bit. Only links that
join two trees of a task's forest leave it, so a group of copies gives no pairs but a tree.

The pipeline's stage asks for similarity 0.8, where about 15 % of a fingerprint's bits differ. There, fingerprints of 23 lanes are
cut into segments of the code's whole length, and each segment's key is one codeword: of those within RADIUS bits, the one whose
differing bits had the closest votes. Rows that share a key are compared by size and by three lanes; of what is near, the shingle sets decide.

Defined cases: a null or empty text, and one of separators only, has the fingerprint 0 and is linked like any
other; fewer words than a shingle's are one shingle; texts of any length are read whole; rows that repeat a
doc_id are of one component if their fingerprints are; a null doc_id never names a component unless all its ids are
null; an empty table gives an empty result; other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stellara.llm.common import cut, free, join_classes, partitions, ship, table
from stellara.llm.components import components

WORDS = 4
BITS = 4
SEED = 42
CHUNK = 1 << 15
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11
RADIUS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = tuple(combinations(range(len(SEGMENTS)), 2))
RUN = 64
SIMILARITY = 0.8
BATCH = 256
#: Of pairs at the similarity, one key in five agrees (in six for sets of 4 and 5 shingles), so that 64 miss under 0.0001 % (0.001 %).
LANES, KEYS = 23, 64
#: Of the bits of CHECK lanes, 29 differ in the mean at the similarity (36 for sets of 4 and 5), with a deviation of 5; 96, of 7, in unlike sets.
CHECK, APART = 3, 64
#: Of the 1,472 bits of all lanes, 223 differ in the mean at the similarity, with a deviation of 14, if sets have over FEW shingles.
WIDE, FEW = 312, 16
#: Runs of a key beyond this many rows are compared in blocks.
LONG, BLOCK = 512, 64
#: No task gets more than about this share of the pairs for one text.
SPREAD = 500


def fingerprint(text: bytes, words: int = WORDS, lanes: int = 1) -> list[int]:
    """The SimHash of a UTF-8 text, 64 bits a lane: bits set where over half of its word shingles have them.
    The first lane's hash is XXH64; each further lane mixes it with numbers of its own."""
    found = text.lower().split()
    if not found:
        return [0] * lanes
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) >= words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros((lanes, 64), np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        total += ballots(np.array([digest(line[s:e], SEED) for s, e in spans], dtype="<u8"), lanes)
    return np.packbits(total * 2 > len(starts), axis=1, bitorder="little").view("<u8").ravel().tolist()


@cache
def turns(lanes: int) -> np.ndarray:
    """What lanes after the first add by exclusive or, and the odd numbers that they multiply by."""
    return np.random.default_rng(SEED).integers(0, 1 << 63, (lanes, 2), dtype=np.uint64)[1:].T * np.uint64(2) + np.uint64(1)


def ballots(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """For each lane's 64 bits, how many hashes have it."""
    total, (turn, by) = np.zeros(lanes * 64, np.int64), turns(lanes)
    for at in range(0, len(hashes), 255):
        own = hashes[at : at + 255, None]
        own = np.concatenate([own, mixed((own ^ turn) * by)], axis=1).astype("<u8", copy=False)
        total += np.unpackbits(own.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return total.reshape(lanes, 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from 64: two rounds of multiplying by an odd number and folding the high bits down."""
    for _ in range(2):
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h


def lanes_of(n: int) -> list[str]:
    return ["fp", *(f"fp{i}" for i in range(1, n))]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, lanes: int = 1) -> DataFrame:
    """key and fp (fp1, ...), the fingerprint as signed 64-bit numbers."""
    ship(docs.sparkSession)
    rows, names = docs.select(key, F.col(text).cast("binary").alias("__text")), lanes_of(lanes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py() or b"", words, lanes) for x in batch.column(1)], dtype=np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fps[:, i]) for i in range(lanes))], [key, *names])

    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def remainder(word: int) -> int:
    """Of a binary polynomial by the generator."""
    while (d := word.bit_length() - GENERATOR.bit_length()) >= 0:
        word ^= GENERATOR << d
    return word


class Golay:
    """Error patterns of up to RADIUS bits by syndrome."""

    def __init__(self) -> None:
        bit = [remainder(1 << i) for i in range(LENGTH)]
        by: list[list[int]] = [[] for _ in range(1 << CHECKS)]
        for weight in range(RADIUS + 1):
            for bits in combinations(range(LENGTH), weight):
                syndrome = 0
                for i in bits:
                    syndrome ^= bit[i]
                by[syndrome].append(sum(1 << i for i in bits))
        self.first = np.cumsum([0, *map(len, by)])
        self.patterns = np.array([p for ps in by for p in ps], dtype=np.int64)
        self.flips = (self.patterns[:, None] >> np.arange(LENGTH) & 1).astype(np.float32)
        self.low, self.high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for i, r in enumerate(bit):
            half, j = (self.low, i) if i < 12 else (self.high, i - 12)
            half[(np.arange(len(half)) >> j) & 1 == 1] ^= r

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, where its patterns begin and how many they are."""
        s = self.low[words & 4095] ^ self.high[words >> 12]
        return self.first[s], self.first[s + 1] - self.first[s]

    def nearest(self, votes: np.ndarray) -> np.ndarray:
        """For each row of LENGTH votes (above 0: a set bit), the index of the codeword within RADIUS bits that the fewest votes are against."""
        words = ((votes > 0) << np.arange(LENGTH)).sum(axis=1)
        first, n = self.near(words)
        row, starts = np.repeat(np.arange(len(words)), n), np.cumsum(n) - n
        at = np.arange(len(row)) - starts[row] + first[row]
        cost = np.einsum("ij,ij->i", self.flips[at], np.abs(votes).astype(np.float32)[row])
        least = np.flatnonzero(cost == np.minimum.reduceat(cost, starts)[row])
        least = least[np.searchsorted(row[least], np.arange(len(words)))]
        return (words ^ self.patterns[at[least]]) >> CHECKS

    def keys(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, rows of fps that have them) for each pair of segments."""
        words = [((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
        near = [self.near(w) for w in words]
        for pair, (a, b) in enumerate(PAIRS):
            (first_a, n_a), (first_b, n_b) = near[a], near[b]
            n = n_a * n_b
            row = np.repeat(np.arange(len(fps)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key_a = (words[a][row] ^ self.patterns[first_a[row] + at // n_b[row]]) >> CHECKS
            key_b = (words[b][row] ^ self.patterns[first_b[row] + at % n_b[row]]) >> CHECKS
            yield (pair << 24 | key_a << 12 | key_b).astype(np.int32), row


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


class Forest:
    """Union-find; fresh holds the links that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.fresh: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.fresh.append((a, b))


def compare(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, bits: int, forest: Forest) -> None:
    """Link the nodes whose fingerprints (a row of lanes each) are within `bits` in each run of equal keys."""
    if not len(keys):
        return
    edges = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1, append=keys[-1] + 1))
    lengths = np.diff(edges)
    for k in np.flatnonzero(lengths > RUN).tolist():
        spread(nodes[edges[k] : edges[k + 1]], fps[edges[k] : edges[k + 1]], bits, forest)
    at, d = np.flatnonzero(np.repeat(lengths <= RUN, lengths)), 1
    while len(at):
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        for i in at[np.bitwise_count(fps[at] ^ fps[at + d]).sum(axis=1) <= bits].tolist():
            forest.link(int(nodes[i]), int(nodes[i + d]))
        d += 1


def spread(nodes: np.ndarray, fps: np.ndarray, bits: int, forest: Forest) -> None:
    """The same for one long run: what is linked once leaves the rows that are still to be compared."""
    while len(nodes):
        front, nodes, fps = [(int(nodes[0]), fps[0])], nodes[1:], fps[1:]
        while front and len(nodes):
            one, own = front.pop()
            hit = np.bitwise_count(fps ^ own).sum(axis=1) <= bits
            if hit.any():
                for x, f in zip(nodes[hit].tolist(), fps[hit], strict=True):
                    forest.link(one, x)
                    front.append((x, f))
                nodes, fps = nodes[~hit], fps[~hit]


def links(classes: DataFrame, bits: int = BITS, lanes: int = 1) -> DataFrame:
    """(a, b): links between the nodes of classes(node, fp, ...), enough to connect what is within `bits` and shares a key.

    With one lane, a node is its fingerprint, and up to BITS bits no link is missed.
    """
    ship(classes.sparkSession)
    names = lanes_of(lanes) if lanes == 1 else ["node", *lanes_of(lanes)]
    skip = len(names) - lanes

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [c.to_numpy() for c in batch.columns]
            for keys, row in golay().keys(own[skip].view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c[row]) for c in own)], ["k", *names])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), []

        def settle() -> None:
            k, f = (np.concatenate(x) for x in zip(*held, strict=True))
            compare(k, f[:, 0], f[:, skip:], bits, forest)

        def fresh() -> pa.RecordBatch:
            out = np.array(forest.fresh, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            forest.fresh = []
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

        for batch in batches:
            k, f = batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(np.uint64)
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))
            if not last and held and held[0][0][0] == k[0]:
                held.append((k, f))
                continue
            held.append((k[:last], f[:last]))
            settle()
            held = [(k[last:], f[last:])]
            if forest.fresh:
                yield fresh()
        if held:
            settle()
        yield fresh()

    keyed = classes.select(*names).mapInArrow(spell, "k int, " + ", ".join(f"{n} long" for n in names))
    # fully sorted, so that a task that is run again gives the same forest
    return keyed.repartition("k").sortWithinPartitions("k", *names).mapInArrow(meet, "a long, b long")


def within(similarity: float, lanes: int) -> int:
    """Differing bits to allow for shingle sets of a Jaccard similarity: the mean of equally large sets and one deviation."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * lanes
    return int(n * share + math.sqrt(n * share * (1 - share)))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted, different hashes of a text's word shingles; none for a text without words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(found), max(len(found) - words + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    spans = zip([0, *(ends[: n - 1] + 1).tolist()], ends[min(words, len(found)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, n))


def segment_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set of shingle hashes, KEYS keys and its fingerprint.

    A key is a segment's number and its codeword. Bits of no vote more for than against are unset, as in any fingerprint."""
    votes = np.stack([2 * ballots(s, LANES).ravel() - len(s) for s in sets])
    words = golay().nearest(votes[:, : KEYS * LENGTH].reshape(-1, LENGTH)).reshape(-1, KEYS)
    checks = np.packbits(votes > 0, axis=1, bitorder="little").view("<u8")
    return (np.arange(KEYS) << 12 | words).astype(np.int32), checks


def set_marks(docs: DataFrame, key: str, text: str, words: int, whole: bool = False) -> DataFrame:
    """key, node (a hash of the text's shingle set), size and either its keys and checks (segment_keys) or, if whole, the set."""
    ship(docs.sparkSession)
    rows, last = docs.select(key, F.col(text).cast("binary").alias("__text")), "set array<long>" if whole else "keys array<int>, checks array<long>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                sets = [shingle_set(x.as_py() or b"", words) for x in part.column(1)]
                node = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
                told = [part.column(0), pa.array(node), pa.array([len(s) for s in sets], pa.int32())]
                if whole:
                    yield pa.RecordBatch.from_arrays([*told, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], [key, "node", "size", "set"])
                    continue
                keys, checks = segment_keys(sets)
                keys = pa.array([k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*told, keys, pa.array(list(checks.view(np.int64)), pa.list_(pa.int64()))], [key, "node", "size", "keys", "checks"])

    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, node long, size int, {last}")


def partnered(keys: np.ndarray, sizes: np.ndarray, checks: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each row, sorted by key and size, has another of its key whose size fits the similarity, within APART bits."""
    found, lanes = np.zeros(len(keys), bool), list(np.ascontiguousarray(checks.T))
    if not len(keys):
        return found
    edges = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1, append=keys[-1] + 1))
    lengths = np.diff(edges)
    for k in np.flatnonzero(lengths > LONG).tolist():
        for i in range(edges[k], edges[k + 1], BLOCK):
            j = min(i + BLOCK, edges[k + 1])
            end = edges[k] + np.searchsorted(sizes[edges[k] : edges[k + 1]], sizes[j - 1] / similarity + 1)
            near = sum(np.bitwise_count(x[i:j, None] ^ x[None, i:end]) for x in lanes) <= APART
            near[np.arange(j - i), np.arange(j - i)] = False
            found[i:j] |= near.any(axis=1)
            found[i:end] |= near.any(axis=0)
    at, d = np.flatnonzero(np.repeat(lengths <= LONG, lengths)), 1
    while len(at):
        at = at[at + d < len(keys)]
        at = at[(keys[at] == keys[at + d]) & (sizes[at] >= similarity * sizes[at + d])]
        hit = at[sum(np.bitwise_count(x[at] ^ x[at + d]) for x in lanes) <= APART]
        found[hit] = found[hit + d] = True
        d += 1
    return found


def met_in_keys(marks: DataFrame, similarity: float) -> DataFrame:
    """(band, node, size): the different nodes of marks under each of their keys, as band, if another node there is near."""
    own = marks.dropDuplicates(["node"]).select("node", "size", "checks", F.explode("keys").alias("band"))
    rows = own.select("band", "size", "node", *[F.col("checks")[i].alias(f"c{i}") for i in range(CHECK)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            band, size, node, *checks = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3 + CHECK))
            near = partnered(band, size, np.stack(checks, axis=1).view(np.uint64), similarity)
            return pa.RecordBatch.from_arrays([pa.array(band[near]), pa.array(node[near]), pa.array(size[near])], ["band", "node", "size"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            band = batch.column(0).to_numpy()
            last = int(np.searchsorted(band, band[-1]))
            if last or (held and held[-1].column(0)[-1].as_py() != band[0]):
                if last:
                    held.append(batch.slice(0, last))
                yield settle(held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield settle(held)

    return rows.repartition("band").sortWithinPartitions("band", "size", "node").mapInArrow(run, "band int, node long, size int")


def with_node(docs: DataFrame, text: str, words: int, node: str) -> DataFrame:
    """docs and, called `node`, the hash of each text's shingle set."""
    ship(docs.sparkSession)
    names = [*docs.columns, node]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([node_of(shingle_set(x.as_py() or b"", words)) for x in batch.column(-1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own)], names)

    schema = StructType([*docs.schema.fields, StructField(node, LongType())])
    return docs.withColumn(node, F.col(text).cast("binary")).mapInArrow(run, schema)


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def with_sets(pairs: DataFrame, sets: DataFrame, end: str, n: int) -> DataFrame:
    """pairs and the set of one end, as `end`_set. A set that many pairs want is copied to several tasks, so that none gets more
    than about 1 / SPREAD of the pairs of that end; only the numbers of copies are broadcast, under SPREAD of them."""
    uses = pairs.groupBy(F.col(end).alias("of")).agg(F.count(F.lit(1)).alias("uses"))
    limit = max(n // SPREAD, 1000)
    copies = F.broadcast(uses.where(F.col("uses") > limit).select("of", F.ceil(F.col("uses") / limit).cast("int").alias("copies")))
    wanted = sets.join(uses.select("of"), F.col("node") == F.col("of"), "left_semi").join(copies, F.col("node") == F.col("of"), "left")
    held = wanted.select("node", F.col("set").alias(f"{end}_set"), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    dealt = pairs.join(copies, F.col(end) == F.col("of"), "left").withColumn("to", F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1))).cast("int")).drop("of", "copies")
    return dealt.join(held, (F.col(end) == F.col("node")) & (F.col("to") == F.col("copy"))).drop("node", "to", "copy")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose shingle sets have the Jaccard similarity; checkpointed."""
    n = pairs.count()
    both = with_sets(with_sets(pairs, sets, "a", n), sets, "b", n)
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return cut(both.where(shared / (F.size("a_set") + F.size("b_set") - shared) >= similarity).select("a", "b"))


def set_links(docs: DataFrame, marks: DataFrame, classes: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """(a, b): links between classes(node, least) that connect all whose sets share a Golay key, called band, and have the similarity.

    First each class is compared with the least of its band. What this leaves apart in a band is then compared
    with all of the band but its own component; the largest component of a band is not compared with itself. A pair that shares
    several bands is compared in the first of them, where it stands apart as in any other, unless all lanes tell that it is far.
    """
    fit = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)
    near = cut(met_in_keys(marks, similarity))
    heads = near.groupBy("band").agg(F.min(F.struct("node", "size")).alias("__head"))
    met = cut(near.join(heads, "band"))
    involved = classes.join(met.select("node").distinct(), "node", "left_semi").select(F.col("least").alias("__least")).distinct()
    own = docs.join(involved, F.col(key).eqNullSafe(F.col("__least")), "left_semi")
    sets = cut(set_marks(own, key, text, words, whole=True).select("node", "set").dropDuplicates(["node"]))
    stars = met.where(F.col("node") != F.col("__head.node")).where(fit(F.col("size"), F.col("__head.size")))
    first = verified(cut(stars.select(F.col("__head.node").alias("a"), F.col("node").alias("b")).distinct()), sets, similarity)
    found = components(first)
    roots = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    placed = met.select("band", "node", "size").join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    shares = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("__n")).groupBy("band").agg(F.max(F.struct("__n", "root")).alias("__most"), F.count(F.lit(1)).alias("__roots"))
    split = cut(placed.join(shares.where("__roots > 1").select("band", F.col("__most.root").alias("__top")), "band"))
    spelt_whole = marks.dropDuplicates(["node"]).select(F.col("node").alias("__of"), F.col("keys").alias("bands"), "checks")
    at = split.groupBy("node", "size", "root").agg(F.collect_list(F.struct("band", "__top")).alias("__at"))  # a row for each node, of KEYS bands at most
    split = at.join(spelt_whole, F.col("node") == F.col("__of")).select("node", "size", "root", "bands", "checks", F.inline("__at"))
    apart = split.where(F.col("root") != F.col("__top")).select(F.col("band").alias("__band"), F.col("node").alias("a"), F.col("size").alias("__size"), F.col("root").alias("__root"), F.col("bands").alias("__bands"), F.col("checks").alias("__checks"))
    once = F.array_position("bands", F.col("band")) == F.array_position("bands", F.element_at(F.array_intersect("bands", "__bands"), 1))
    unlike = (F.col("root") != F.col("__root")) & ((F.col("root") == F.col("__top")) | (F.col("a") < F.col("node")))
    differ = sum(F.bit_count(F.col("checks")[i].bitwiseXOR(F.col("__checks")[i])) for i in range(LANES))
    close = (F.least("size", "__size") <= FEW) | (differ <= WIDE)
    rest = apart.join(split, (F.col("band") == F.col("__band")) & unlike & fit(F.col("size"), F.col("__size")) & close & once)
    pairs = rest.select("a", F.col("node").alias("b"))
    return first.unionByName(verified(cut(pairs), sets, similarity))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, lanes: int = 1) -> DataFrame:
    """key, fp and component: the smallest key that links lead to.

    With more than one lane, `bits` is not used: texts link if their shingle sets have the SIMILARITY, and fp is a hash of the set.
    """
    if lanes > 1:
        return similar(docs, key, text, words).select(key, F.col("node").alias("fp"), "component")
    marks = cut(fingerprints(docs, key, text, words).withColumn("node", F.col("fp")))
    named, known = grouped(marks, lambda classes: links(classes.select("fp"), bits), key)
    return join_classes(marks, named.select("node", "component", "n"), "node", known, "n").select(key, "fp", "component")


def similar(docs: DataFrame, key: str, text: str, words: int, similarity: float = SIMILARITY) -> DataFrame:
    """key, node and component, by the Jaccard similarity of shingle sets; texts of equal sets have one node."""
    marks, named, known = set_classes(docs, key, text, words, similarity)
    return join_classes(marks.select(key, "node"), named.select("node", "component", "n"), "node", known, "n")


def set_classes(docs: DataFrame, key: str, text: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame, int]:
    """The marks of docs, what grouped() says of their classes, and how many rows there are."""
    marks = cut(set_marks(docs, key, text, words))
    return marks, *grouped(marks, lambda classes: set_links(docs, marks, classes, key, text, words, similarity), key)


def grouped(marks: DataFrame, linked: Callable[[DataFrame], DataFrame], key: str) -> tuple[DataFrame, int]:
    """Classes of equal nodes of marks(key, node, ...) and the number of rows. A class has node, component, n rows, its least key
    and head, the one node of its component that has the component's key (nulls last)."""
    classes = cut(marks.groupBy("node").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")).withColumn("fp", F.col("node")))
    known = classes.agg(F.sum("n")).first()[0] or 0
    found = components(linked(classes.repartition(partitions(marks.sparkSession))))
    rooted = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    member = cut(rooted.join(classes, "node").select("node", "root", "least"))
    lowest = member.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("void"), "least", "node")).alias("low"))
    low = member.join(lowest, "root").select(F.col("node").alias("__node"), "low")
    named = classes.join(low, F.col("node") == F.col("__node"), "left")
    return cut(named.select("node", F.coalesce("low.least", "least").alias("component"), "n", "least", F.coalesce("low.node", "node").alias("head"))), known


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group stays: one with the smallest key, nulls last. Rows that repeat a key, or have none, are told apart by their texts.

    Texts link if their sets of word shingles have the Jaccard similarity. Golay keys of the sets' fingerprints propose what is compared.
    """
    marks, named, _ = set_classes(docs.select(key, text), key, text, words, similarity)
    own, of, node = (free(docs, n) for n in ("own", "of", "node"))
    kept = named.where("node = head").select(F.col("least").alias(of), F.col("node").alias(node))
    repeated = cut(marks.groupBy(F.col(key).alias(of)).count().where("count > 1").select(of))
    again = F.col(key).eqNullSafe(F.col(of))
    stays = docs.join(kept.select(of).distinct(), again, "left_semi")
    if repeated.isEmpty():
        return stays
    marked = with_node(stays.join(repeated, again, "left_semi"), text, words, own).dropDuplicates([key, own])
    one = marked.join(kept, again & (F.col(own) == F.col(node)), "left_semi").drop(own)
    return stays.join(repeated, again, "left_anti").unionByName(one)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
