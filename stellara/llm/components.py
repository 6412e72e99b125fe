"""Connected components of a link table, as joins and minima over checkpointed tables.

Large and small stars alternate: each node links its larger neighbours to the least it knows, then its
smaller ones, until the links are stars around each component's least node. No component is ever gathered
in one task: minima combine before the shuffle, and the few nodes with very many links (under HUBS of them) are broadcast
with their minima, so that their links stay where they are.

Defined cases: no links give an empty result; links of a node to itself and links with nulls are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellara.llm.common import cut


#: A node is a hub with over 1 / HUBS of the links, and HUB_LINKS at least.
HUBS, HUB_LINKS = 1000, 10_000


def _least(pairs: DataFrame, n: int) -> DataFrame:
    """Each of n pairs (u, v), or fewer, with the least of u and all v that go with u."""
    low = pairs.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m"), F.count(F.lit(1)).alias("__n"))
    met, told = F.col("u") == F.col("__u"), ["u", "v", F.least("__u", "__m").alias("m")]
    limit = max(n // HUBS, HUB_LINKS)
    if n <= limit:
        return pairs.join(low, met).select(*told)
    hubs = F.broadcast(low.where(F.col("__n") > limit))
    rest = pairs.join(hubs, met, "left_anti").join(low.where(F.col("__n") <= limit), met)
    return pairs.join(hubs, met).select(*told).unionByName(rest.select(*told))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the least node of its component."""
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, before = cut(pairs), None
    while True:
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now == before or not now["n"]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * now["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        met = _least(large, 2 * now["n"])
        small = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        pairs = cut(small.distinct())
