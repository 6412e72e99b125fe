"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with the share w of the wanted rows and n rows of its own repeats each of them
rate = w * wanted / n times in the mean. A document's count inverts the Poisson distribution of that
rate at a number hashed from (seed, doc_id): the same document always gets the same count. Documents
are exploded by their counts, and every copy goes to a place hashed from (seed, doc_id, copy).

Defined cases: a null source is a source of its own; a source without a weight (with weights given) has the weight
`other`, 0 unless stated; a null doc_id hashes as the empty string; rows that repeat a doc_id get the same count; an empty
table gives an empty result; texts may be null, empty or long, as they are not looked at; other columns, whatever their
names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellara.llm.common import cut, folded, join_small, table, unfolded, unit

#: Rates above this are sums of several Poisson numbers, for exp(-rate) not to vanish.
PART_RATE = 64.0
SEED = "mix-1"
ALPHA = 0.5
#: The target weights of op6; a source that is not named has the weight OTHER.
WEIGHTS, OTHER = {f"src{i}": 1.0 + i % 4 for i in range(20)}, 1.0


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0, source: str = "source", other: float = 0.0) -> DataFrame:
    """A row for each source: source, n, rate. Without weights, a source of n rows weighs n ** alpha."""
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        pairs = [(k, float(v)) for k, v in weights.items()]
        known = docs.sparkSession.createDataFrame(pairs, "k string, w double")
        weighed = n.join(known, F.col("source").eqNullSafe(F.col("k")), "left").drop("k").fillna(other, ["w"])
    weighed = cut(weighed)
    whole = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    per_weight = whole["n"] * epochs / whole["w"] if whole["w"] else 0.0
    return weighed.select("source", "n", (F.col("w") * F.lit(per_weight) / F.col("n")).alias("rate"))


def cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... until nothing is left in double precision."""
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(24.0)).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda acc: acc["c"])


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: str = SEED, key: str = "doc_id", source: str = "source", other: float = 0.0, detail: bool = False) -> DataFrame:
    """The replicated rows, globally shuffled, with the columns of `docs`.

    With detail, these are rate, n_copies, copy (1, 2, ...), place (32 hex digits) and row, a struct of all columns.
    """
    known = rates(docs, weights, alpha, epochs, source, other).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int")))
    known = cut(known.withColumn("cdf", cumulative(F.col("rate") / F.col("parts"))).drop("n"))
    rows = join_small(folded(docs, key=F.col(key), source=F.col(source)), known, "source", known.count(), F.xxhash64("key"))

    def part(j: Column) -> Column:
        u = unit(seed, F.col("key"), j)
        return F.size(F.filter(F.col("cdf"), lambda c: c <= u))

    counted = rows.select("row", "key", "rate", F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), part), F.lit(0), lambda a, x: a + x).alias("n_copies"))
    copies = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("copy").cast("string")))
    out = copies.withColumn("place", place).drop("key").repartition("place").sortWithinPartitions("place")
    return out if detail else unfolded(out, docs)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), WEIGHTS, other=OTHER, detail=True)
    return out.select("row.doc_id", "row.source", "row.text", F.round("rate", 6).alias("rate"), "n_copies", "copy", "place")


OP6_SQL = f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
g AS (SELECT *, CASE WHEN regexp_full_match(source, 'src1?[0-9]') THEN 1 + CAST(substr(source, 4) AS INTEGER) % 4 ELSE 1 END AS weight FROM s),
t AS (SELECT sum(weight) AS w, sum(n) AS all_n FROM g),
r AS (SELECT source, weight * (all_n / w) / n AS rate FROM g, t),
d AS (
  SELECT doc_id, d.source, d.text, rate,
         (('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT CAST(range AS INTEGER) AS k FROM range(0, 200)),
cdf AS (SELECT r.source, sum(exp(-rate + k.k * ln(rate) - lgamma(k.k + 1.0))) OVER (PARTITION BY r.source ORDER BY k.k) AS c, k.k FROM r, k),
n AS (SELECT doc_id, d.source, d.text, rate, CAST((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS INTEGER) AS n_copies FROM d)
SELECT doc_id, source, text, round(rate, 6) AS rate, n_copies, copy,
       md5('{SEED}:place:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS place
FROM (SELECT doc_id, source, text, rate, n_copies, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM n)
"""
