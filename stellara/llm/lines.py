"""Line dedup by a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: its token count, then its LEAD first tokens, tokens with a digit
counting as one variable field. At the leaf its tokens are four blocks, as even as may be; the first is fixed, and two lines of a
leaf which differ in one of the others only have one template, that block being variable. So a line
stands under one exact template and, if it has BLOCK_TOKENS tokens or more, under three with an open block, each
named by two 64-bit hashes. A template that occurs in several documents recurs: its lines stay in the document of
least id and are dropped from all others.

Defined cases: blank lines stay; null texts stay null, empty ones empty; a document may lose all of its lines, its
text being empty then; rows that repeat a doc_id are one document; a null doc_id comes after all others, and its
rows are one document; texts of any length are read whole; an empty table gives an empty result; other columns stay as
they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellara.llm.common import folded, table, ticked

LEAD = 3
BLOCKS = 4
BLOCK_TOKENS = 8
OPEN = (1, 2, 3)
FIELD = "<*>"
#: White space inside lines, as in Java's and RE2's \\s.
SPACE = "[ \\t\\x0B\\f\\r]+"


def _tokens(line: Column) -> Column:
    """The tokens of a line, white space at its ends left off; costly patterns run only where they can match."""
    plain = F.trim(F.when(line.rlike("  |[\\t\\x0B\\f\\r]"), F.regexp_replace(line, SPACE, " ")).otherwise(line))
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(plain)
    return F.split(masked, " ", -1)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, row (a hash of the key and the text), at (the line's number), a and b (a template): a row for each line and template."""
    own = docs.select(F.col(key).alias("doc"), F.xxhash64(key, text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    told = own.where(~F.col("line").rlike("^[ \\t\\x0B\\f\\r]*$")).select("doc", "row", "at", _tokens(F.col("line")).alias("tokens"))
    sized = told.withColumn("n", F.size("tokens"))
    end = lambda i: F.floor(F.col("n") * i / BLOCKS).cast("int")
    blocks = [F.xxhash64(F.slice("tokens", end(i) + 1, end(i + 1) - end(i))) for i in range(BLOCKS)]
    hashed = sized.select("doc", "row", "at", "n", F.array(*blocks).alias("blocks"), F.xxhash64(F.slice("tokens", 1, LEAD)).alias("lead"))

    def name(which: str, kept: list[int]) -> Column:
        own = [F.col("blocks")[i] for i in kept]
        return F.struct(F.xxhash64(F.lit(which), "n", "lead", *own).alias("a"), F.xxhash64(*own[::-1], F.lit(which), "lead", "n").alias("b"))

    exact, open_ = name("line", list(range(BLOCKS))), [name(f"open {j}", [i for i in range(BLOCKS) if i != j]) for j in OPEN]
    names = F.explode(F.when(F.col("n") >= BLOCK_TOKENS, F.array(exact, *open_)).otherwise(F.array(exact)))
    return hashed.select("doc", "row", "at", names.alias("t")).select("doc", "row", "at", "t.a", "t.b")


def recurring(rows: DataFrame) -> DataFrame:
    """row, at of the lines to be dropped: those under a template that a document of a lesser id has. Partial
    minima come before the shuffle, and the join of a template that very many lines share is left for adaptive execution to split."""
    found = rows.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("void"))
    again = found.where((F.col("last") > F.col("first")) | (F.col("void") & F.col("first").isNotNull())).select("a", "b", "first")
    later = F.col("doc").isNull() | (F.col("doc") > F.col("first"))
    return rows.join(again, ["a", "b"]).where(later).select("row", "at")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", detail: bool = False) -> DataFrame:
    """`docs` without recurring lines. With detail, the columns doc_id, text, n_lines and n_dropped.

    Lines are dropped row by row, a row being known by the hash of its key and text: no group is larger than a text.
    """
    dropped = recurring(lines(docs, key, text)).groupBy("row").agg(F.collect_set("at").alias("dropped")).withColumnRenamed("row", "of")
    joined = folded(docs, hash=F.xxhash64(key, text)).join(dropped, F.col("hash") == F.col("of"), "left")
    own = F.col(f"row.{ticked(text)}")
    parts = F.split(own, "\n", -1)
    stays = F.filter(parts, lambda x, i: ~F.array_contains("dropped", i))
    cleaned = F.when(F.col("dropped").isNull(), own).otherwise(F.array_join(stays, "\n"))
    if detail:
        n = F.coalesce(F.size("dropped"), F.lit(0))
        return joined.select(F.col(f"row.{ticked(key)}").alias("doc_id"), cleaned.alias("text"), F.when(own.isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(n).alias("n_dropped"))
    return joined.select(*[(cleaned if c == text else F.col(f"row.{ticked(c)}")).alias(c) for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), detail=True)


_SLICES = [f"m[n * {i} // {BLOCKS} + 1 : n * {i + 1} // {BLOCKS}]" for i in range(BLOCKS)]
_OPENED = ", ".join(f"['open {j}', CAST(n AS VARCHAR)] || m[1:{LEAD}] || " + " || ".join(f"['|'] || {x}" for i, x in enumerate(_SLICES) if i != j) for j in OPEN)
OP9_SQL = f"""
WITH r AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS rn FROM documents),
l AS (SELECT doc_id, rn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM r),
p AS (SELECT doc_id, rn, pos, trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS plain FROM l),
m AS (SELECT doc_id, rn, pos, string_split(regexp_replace(plain, '[^ ]*[0-9][^ ]*', '{FIELD}', 'g'), ' ') AS m FROM p WHERE plain <> ''),
s AS (SELECT *, len(m) AS n FROM m),
t AS (SELECT doc_id, rn, pos, unnest(CASE WHEN n >= {BLOCK_TOKENS} THEN [['line'] || m, {_OPENED}] ELSE [['line'] || m] END) AS t FROM s),
k AS (SELECT t, min(doc_id) AS first_doc FROM t GROUP BY t),
d AS (SELECT DISTINCT rn, pos FROM t JOIN k USING (t) WHERE doc_id > first_doc OR (doc_id IS NULL AND first_doc IS NOT NULL)),
w AS (SELECT rn, list(pos) AS dropped FROM d GROUP BY rn),
o AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts, dropped FROM r LEFT JOIN w USING (rn))
SELECT doc_id,
       CASE WHEN dropped IS NULL THEN text ELSE array_to_string(list_filter(parts, lambda x, i: NOT list_contains(dropped, i)), chr(10)) END AS text,
       CAST(coalesce(len(parts), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(dropped), 0) AS INTEGER) AS n_dropped
FROM o
"""
