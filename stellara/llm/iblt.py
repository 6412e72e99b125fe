"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs are its lines; those over LEAST code points are cut at the first end of a sentence after that many, at PIECE code
points at the latest, so that the pieces after an insertion soon are the old ones again. They are hashed to digests. A sketch has
TABLES rows of WIDTH cells; a digest goes to one cell of each row, adding to its count and, by exclusive or, to its key and its check. Sketches of two versions subtract cell by
cell; what both have is gone, and cells with one digest left are peeled until the differing digests are recovered or
nothing more comes off. Then a larger sketch is tried: 4 times the cells, split by a digest's low bits into
sub-sketches of the first size, with other bits choosing cells. Should LEVELS sizes fail, the sets are compared.

Likeness is the share of digests that both versions have among all that either has, from the recovered difference.

Defined cases: a null text is the empty one, which has no digests; two texts without digests are alike (1); a paragraph that repeats
counts once; the next document of one with a null doc_id, or of ties, is by (doc_id, nulls last; XXH64 of the text; text); a single
document is its own next; texts of any length are read whole; an empty table gives an empty result; other columns, whatever their names,
do no harm.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellara.llm.common import table

LEAST, PIECE = 320, 480
PIECES = f"(?:[^\\n]{{{LEAST},{PIECE - 1}}}?[.!?]|[^\\n]{{1,{PIECE}}})\\n*|\\n+"
TABLES, WIDTH, BITS = 3, 16, 4
LEVELS = 9
ROUNDS = 16
#: Rows that a bucket of neighbours is to have, and buckets at most (they get more rows then): their first rows are broadcast.
BUCKET_ROWS, BUCKETS = 1024, 65_536
#: Borders that are looked through at a time, at least.
STRIDE = 8

_CELL = "named_struct('c', {c}, 'k', {k}, 'h', {h})"
_CHECK = "(xxhash64({x}) & 4294967295L)"


def _hit(x: str, cell: str, shift: str) -> str:
    """Whether digest x goes to the cell: in row cell div WIDTH, the digest's bits name the column."""
    return f"(shiftrightunsigned({x}, {shift} + {BITS} * ({cell} div {WIDTH})) & {WIDTH - 1}) = {cell} % {WIDTH}"


def _sketch(digests: str, shift: str) -> str:
    added = _CELL.format(c="a.c + 1", k="a.k ^ x", h="a.h ^ " + _CHECK.format(x="x"))
    return f"transform(sequence(0, {TABLES * WIDTH - 1}), i -> aggregate(filter({digests}, y -> {_hit('y', 'i', shift)}), {_CELL.format(c='0', k='0L', h='0L')}, (a, x) -> {added}))"


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> {_CELL.format(c='p.c - q.c', k='p.k ^ q.k', h='p.h ^ q.h')})"


def _peel(cells: str, shift: str) -> str:
    """struct(ok, found): the digests of the difference, peeled round by round, all pure cells at once."""
    pure = f"array_distinct(transform(filter(s.cells, c -> abs(c.c) = 1 AND {_CHECK.format(x='c.k')} = c.h), c -> named_struct('k', c.k, 'c', c.c)))"
    taken = _CELL.format(c="u.c - v.c", k="u.k ^ v.k", h="u.h ^ " + _CHECK.format(x="v.k"))
    cells_left = f"transform(t.cells, (c, j) -> aggregate(filter(pure, w -> {_hit('w.k', 'j', shift)}), c, (u, v) -> {taken}))"
    none = "CAST(array() AS array<struct<k: bigint, c: int>>)"
    turn = f"aggregate(array({pure}), s, (t, pure) -> IF(size(pure) = 0, named_struct('cells', t.cells, 'found', t.found, 'on', false), named_struct('cells', {cells_left}, 'found', concat(t.found, pure), 'on', true)))"
    run = f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', {none}, 'on', true), (s, round) -> IF(s.on, {turn}, s))"
    return f"aggregate(array({run}), named_struct('ok', false, 'found', {none}), (z, r) -> named_struct('ok', forall(r.cells, c -> c.c = 0 AND c.k = 0 AND c.h = 0), 'found', r.found))"


def _difference(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """struct(ok, found, level): the first level as the given sketches, then larger ones from the digests a and b."""
    none = "CAST(array() AS array<struct<k: bigint, c: int>>)"
    shift = f"(16 + {TABLES * BITS} * (level % 4))"
    part = "filter({d}, x -> (x & (shiftleft(1L, 2 * level) - 1)) = g)"
    group = _peel(_subtract(_sketch(part.format(d=a), shift), _sketch(part.format(d=b), shift)), shift)
    groups = f"aggregate(sequence(0L, shiftleft(1L, 2 * level) - 1), named_struct('ok', true, 'found', {none}), (acc, g) -> IF(acc.ok, aggregate(array({group}), acc, (old, new) -> named_struct('ok', new.ok, 'found', concat(old.found, new.found))), acc))"
    hopeless = f"abs(size({a}) - size({b})) > {TABLES * WIDTH} * shiftleft(1L, 2 * level)"
    again = f"IF({hopeless}, best, aggregate(array({groups}), best, (old, new) -> named_struct('ok', new.ok, 'found', new.found, 'level', level)))"
    first = f"aggregate(array({_peel(_subtract(sketch_a, sketch_b), '16')}), named_struct('ok', false, 'found', {none}, 'level', 0), (old, new) -> named_struct('ok', new.ok, 'found', new.found, 'level', 0))"
    tried = f"aggregate(sequence(1, {LEVELS - 1}), {first}, (best, level) -> IF(best.ok, best, {again}))"
    rest = f"concat(transform(array_except({a}, {b}), k -> named_struct('k', k, 'c', 1)), transform(array_except({b}, {a}), k -> named_struct('k', k, 'c', -1)))"
    return f"aggregate(array({tried}), named_struct('ok', false, 'found', {none}, 'level', 0), (z, r) -> IF(r.ok, r, named_struct('ok', true, 'found', {rest}, 'level', {LEVELS})))"


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda p: F.xxhash64(p)))


def sketch(name: str) -> Column:
    """The first sketch of a column of digests."""
    return F.expr(_sketch(name, "16"))


def written(name: str, sketch_name: str) -> Column:
    """A sketch as a string: the number of digests, then all cells."""
    cells = f"transform({sketch_name}, c -> concat(lpad(hex(c.c & 65535), 4, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.h), 8, '0')))"
    return F.expr(f"concat(size({name}), ':', regexp_replace(base64(unhex(array_join({cells}, ''))), '\\\\s', ''))")


def difference(a: str, b: str, sketch_a: str, sketch_b: str) -> Column:
    return F.expr(_difference(a, b, sketch_a, sketch_b))


def likeness(a: str, b: str, found: str) -> Column:
    sizes = f"size({a}) + size({b})"
    return F.expr(f"IF({sizes} + size({found}) = 0, 1.0D, CAST({sizes} - size({found}) AS double) / CAST({sizes} + size({found}) AS double))")


def borders(rows: DataFrame) -> list[tuple[int, int, int]]:
    """Where buckets of about BUCKET_ROWS rows of (key, o) begin, as (key is null, key, hash of the text): quantiles of the keys; a key
    that alone has more rows is cut into ranges of hashes. At most about 2 * BUCKETS numbers come to the driver."""
    n = rows.count()
    size = max(BUCKET_ROWS, math.ceil(n / BUCKETS))
    parts = math.ceil(n / size)
    if parts < 2:
        return []
    least, most = -(1 << 63), (1 << 63) - 1
    at = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("at")).first()["at"] or []
    found = {(0, k, least) for k in at}
    often = sorted({k for k, after in zip(at, at[1:], strict=False) if k == after})
    counts = rows.where(F.col("key").isin(often) | F.col("key").isNull()).groupBy("key").count().collect()
    for k, c in ((r["key"], r["count"]) for r in counts):
        m = math.ceil(c / size)
        own = (1, 0) if k is None else (0, k)
        found |= {(*own, least + (i << 64) // m) for i in range(m)}
        if k is not None and k < most:
            found.add((0, k + 1, least))
    return sorted(found)


def bucket_of(order: Column, found: list[tuple[int, int, int]]) -> Column:
    """How many borders are not after a row, by two steps over a sorted literal."""
    if not found:
        return F.lit(0)
    kind, stride = "array<struct<void: int, key: bigint, mark: bigint>>", max(STRIDE, math.isqrt(len(found)))
    held = lambda rows: F.from_json(F.lit(json.dumps([dict(zip(("void", "key", "mark"), r, strict=True)) for r in rows])), kind)
    block = F.greatest(F.size(F.filter(held(found[::stride]), lambda c: c <= order)) - 1, F.lit(0)) * stride
    return block + F.size(F.filter(F.slice(held(found), block + 1, stride), lambda c: c <= order))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (an integer), text and next: the text of the next document by key, the first one's after the last.

    Rows are in buckets of about equal size; inside a bucket the next row is the next document. The last row of a
    bucket takes the first text of the next bucket that has rows, found by its place in the order.
    """
    order = F.struct(F.col(key).isNull().cast("int").alias("void"), F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), order.alias("o"))
    dealt = rows.withColumn("bucket", bucket_of(F.col("o"), borders(docs.select(F.col(key).cast("long").alias("key")))))
    firsts = dealt.groupBy("bucket").agg(F.min("o").alias("o"))
    in_order = Window.orderBy("bucket")
    all_ = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select(F.col("bucket").alias("of"), F.coalesce(F.lead("o").over(in_order), F.first("o").over(all_)).alias("o"))
    heads = rows.join(F.broadcast(following), "o").groupBy("of").agg(F.min("text").alias("head"))
    led = dealt.withColumn("next", F.lead("text").over(Window.partitionBy("bucket").orderBy("o", "text")))
    joined = led.join(heads, F.col("bucket") == F.col("of"), "left")
    return joined.select("key", "text", F.coalesce("next", "head").alias("next"))


def compare_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the edited text and all that op1 reports, with the recovered digests of both differences."""
    half = F.expr("length(text) div 2").cast("int")
    edited = with_next(docs, key, text).withColumn("edited", F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.substring(F.col("next"), F.lit(1), half)))
    hashed = edited.select(F.col("key").alias(key), F.length("text").cast("long").alias("n_chars"), F.col("edited").alias("__edited"), digests(F.col("text")).alias("__a"), digests(F.col("edited")).alias("__e"), digests(F.col("next")).alias("__n"))
    sketched = hashed.withColumns({"__sa": sketch("__a"), "__se": sketch("__e"), "__sn": sketch("__n")})
    told = sketched.withColumns({"__de": difference("__a", "__e", "__sa", "__se"), "__dn": difference("__a", "__n", "__sa", "__sn")})
    return told.select(
        key, "n_chars", F.col("__edited").alias("edited"), F.sha2("__edited", 256).alias("edited_sha256"), written("__a", "__sa").alias("fingerprint"), written("__e", "__se").alias("edited_fingerprint"),
        likeness("__a", "__e", "__de.found").alias("near_edited"), likeness("__a", "__n", "__dn.found").alias("near_next"),
        F.col("__de.found").alias("edited_digests"), F.col("__dn.found").alias("next_digests"), F.col("__de.level").alias("edited_level"), F.col("__dn.level").alias("next_level"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_next(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("edited_digests").alias("edited_recovered"), "edited_level", F.size("next_digests").alias("next_recovered"), "next_level")
