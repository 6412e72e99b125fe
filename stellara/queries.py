"""A query for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellara.functions import bits
from stellara.operators import bitmaps, encoding, partitions
from stellara.operators.predicates import EQ, EQ_OR_EQ, GE, GT, GT_AND_LE, LE, Predicate, scan
from stellara.plans import ssb
from stellara.plans.script import MEASURES, Dimension, StarQuery, parse
from stellara.plans.star import JOINS, SCANS, join_counts, joined, post_aggregate, pre_aggregate, run, run_script, scan_counts, sql
from stellara.schema import DIMENSIONS, key_of
from stellara.run import execute
from stellara.session import cut, remove, shared_folder
from stellara.sources import files, parameters, store
from stellara.sources.views import VIEWS_SQL, Star

Query = Callable[[SparkSession, str], DataFrame]
PART_ROWS = 12_000
_FACT = ["lo_orderkey", "lo_linenumber", "lo_partkey", "lo_suppkey", "lo_quantity", "lo_discount", "lo_revenue"]
_JOINS = {"supplier": "lo_suppkey", "customer": "lo_custkey", "part": "lo_partkey", "date": "lo_orderdate"}
_FILTERS = {"supplier": Predicate("s_region", EQ, ("ASIA",)), "customer": Predicate("c_nation", EQ, ("NATION_11",)), "part": Predicate("p_mfgr", EQ_OR_EQ, ("MFGR#1", "MFGR#2")), "date": Predicate("d_year", GT_AND_LE, (1995, 1997))}


def _star(f: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Star(spark, sf_dir))


def _query(measure: str, groups: dict[str, str] | None = None, filters: tuple[str, ...] = (), predicates: list[Predicate] | None = None) -> StarQuery:
    groups = groups or {}
    names = [d for d in DIMENSIONS if d in groups or d in filters]
    return StarQuery("", {d: Dimension(d, [_FILTERS[d]] if d in filters else [], groups.get(d)) for d in names}, predicates or [], {d: _JOINS[d] for d in names}, measure)


_SCANS = {
    "scan_eq_int": ("lineorder", [Predicate("lo_quantity", EQ, (24,))]),
    "scan_eq_str": ("customer", [Predicate("c_region", EQ, ("ASIA",))]),
    "scan_le": ("lineorder", [Predicate("lo_quantity", LE, (24,))]),
    "scan_ge": ("lineorder", [Predicate("lo_quantity", GE, (40,))]),
    "scan_gt": ("lineorder", [Predicate("lo_discount", GT, (7,))]),
    "scan_gt_and_le": ("lineorder", [Predicate("lo_discount", GT_AND_LE, (3, 6))]),
    "scan_eq_or_eq": ("part", [Predicate("p_mfgr", EQ_OR_EQ, ("MFGR#1", "MFGR#2"))]),
    "scan_all": ("supplier", []),
    "scan_conj_fact": ("lineorder", [Predicate("lo_discount", GT_AND_LE, (0, 3)), Predicate("lo_quantity", LE, (24,))]),
    "scan_conj_dim": ("date", [Predicate("d_weeknuminyear", EQ, (6,)), Predicate("d_year", EQ, (1996,))]),
}
_COUNTED = parse(ssb.SCRIPTS["q1_1"])
_MULTI = parse(ssb.SCRIPTS["q4_1"])
_AGGREGATES = {
    "agg_global_product": _query(MEASURES[1], filters=("date",), predicates=[Predicate("lo_discount", GT_AND_LE, (0, 3))]),
    "agg_unfiltered": _query(MEASURES[0]),
    "agg_elided": StarQuery("", {"supplier": Dimension("supplier"), "date": Dimension("date", [], "d_year")}, [], {"supplier": "lo_suppkey", "date": "lo_orderdate"}, MEASURES[0]),
    "agg_rev_1key": _query(MEASURES[0], {"date": "d_year"}, ("supplier",)),
    "agg_rev_2key": _query(MEASURES[0], {"supplier": "s_nation", "date": "d_year"}, ("supplier",)),
    "agg_rev_3key": _query(MEASURES[0], {"supplier": "s_nation", "customer": "c_city", "date": "d_year"}, ("supplier", "customer", "date")),
    "agg_profit_2key": _query(MEASURES[2], {"customer": "c_nation", "date": "d_year"}, ("part",)),
    "agg_profit_3key": _query(MEASURES[2], {"supplier": "s_nation", "part": "p_category", "date": "d_year"}, ("date",)),
    "agg_str_key": _query(MEASURES[0], {"part": "p_brand1"}, predicates=[Predicate("lo_discount", GT_AND_LE, (0, 3)), Predicate("lo_quantity", LE, (24,))]),
}
_POST = [Predicate("lo_quantity", LE, (24,))]


def _scanned(star: Star, table: str, predicates: list[Predicate]) -> DataFrame:
    return scan(star.lineorder(_FACT) if table == "lineorder" else star.view(table), predicates)


def _semi(star: Star, names: tuple[str, ...]) -> DataFrame:
    rows = star.lineorder([*_FACT, *(_JOINS[n] for n in names)])
    for name in names:
        rows = rows.join(scan(star.view(name), [_FILTERS[name]]).select(key_of(name)), F.col(_JOINS[name]) == F.col(key_of(name)), "left_semi")
    return rows


def _copart(star: Star) -> DataFrame:
    """The part semi join with both keys as 16-bit halves."""
    hi, lo = encoding.halves("p_partkey")
    side = scan(star.part(), [_FILTERS["part"]]).select(hi, lo)
    rows = star.lineorder(_FACT)
    high, low = F.shiftright("lo_partkey", 16), F.col("lo_partkey").bitwiseAND(65535)
    return rows.join(side, (high == side["hi"]) & (low == side["lo"]), "left_semi")


def _composite(star: Star) -> DataFrame:
    """Revenue by the mixed-radix number of (region of the supplier, year), with both labels."""
    region, year = cut(encoding.dictionary(star.supplier(), "s_region")), cut(encoding.dictionary(star.date(), "d_year"))
    totals = run(star, _query(MEASURES[0], {"supplier": "s_region", "date": "d_year"}))
    coded = encoding.encode(encoding.encode(totals, "s_region", region, "k0"), "d_year", year, "k1")
    return coded.select(encoding.composite([("k0", region.count()), ("k1", year.count())]).alias("id"), "s_region", "d_year", "total")


def _encoded_key(star: Star) -> DataFrame:
    """Fact rows by the code that the supplier key's dictionary gives the foreign key."""
    codes = encoding.dictionary(star.supplier(), "s_suppkey")
    return encoding.encode(star.lineorder(["lo_suppkey"]), "lo_suppkey", codes, "code").groupBy("lo_suppkey", F.col("code").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _decoded(star: Star) -> DataFrame:
    codes = cut(encoding.dictionary(star.part(), "p_brand1"))
    coded = encoding.encode(star.part().select("p_partkey", "p_brand1"), "p_brand1", codes, "code").drop("p_brand1")
    return encoding.decode(coded, "code", codes, "p_brand1").select("p_partkey", "code", "p_brand1")


def _groupby_map(star: Star) -> DataFrame:
    codes = encoding.dictionary(star.supplier(), "s_nation")
    return encoding.encode(star.supplier().select("s_suppkey", "s_nation"), "s_nation", codes, "group_code").select("s_suppkey", "group_code")


def _pack(star: Star) -> DataFrame:
    codes = encoding.dictionary(star.customer(), "c_nation")
    return encoding.packed(encoding.encode(star.customer(), "c_nation", codes, "code"), "c_custkey", "code", 8)


def _map(star: Star, *predicates: Predicate) -> DataFrame:
    holds = F.lit(True)
    for p in predicates:
        holds = holds & p.on()
    return bitmaps.bitmap(star.customer(), "c_custkey", holds)


_ASIA, _SEGMENT = Predicate("c_region", EQ, ("ASIA",)), Predicate("c_mktsegment", EQ, ("BUILDING",))


def _join_map(star: Star) -> DataFrame:
    """Orders, by key, whose customer is in Asia."""
    side = scan(star.customer(), [_ASIA]).select("c_custkey", F.lit(True).alias("hit"))
    rows = star.raw("orders").select("o_orderkey", "o_custkey").join(side, F.col("o_custkey") == F.col("c_custkey"), "left")
    return bitmaps.bitmap(rows, "o_orderkey", F.coalesce("hit", F.lit(False)))


def _probe(star: Star) -> DataFrame:
    words = _map(star, _ASIA).select("word_id", "word")
    rows = star.customer().select("c_custkey", F.expr("c_custkey div 64").alias("__w")).join(words, F.col("__w") == F.col("word_id"))
    return rows.select("c_custkey", bits.bit_at(F.col("word"), F.col("c_custkey")).cast("int").alias("bit"))


def _from_files(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What is read from files that were written to the shared folder; they are deleted once they are read."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write(folder)
    out = cut(read(folder))
    remove(spark, folder)
    return out


def _delimited(star: Star) -> DataFrame:
    """Suppliers written as a delimited table and read again."""
    rows = star.raw("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    kept = [F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_nationkey", "s_acctbal"]
    return _from_files(star.spark, lambda to: files.write_delimited(rows, to), lambda at: files.read_delimited(star.spark, at, rows.columns).select(*kept))


_COLUMN_FILES = {0: "o_orderkey", 3: "o_orderstatus", 5: "o_totalprice"}


def _column_files(star: Star) -> DataFrame:
    """Columns of orders written as a file each, in several parts, read again and joined by row."""
    rows = star.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice").where("o_orderkey IS NOT NULL")
    read = lambda at: files.read_columns(star.spark, at, _COLUMN_FILES).withColumn("o_orderkey", F.col("o_orderkey").cast("long")).drop("row")
    return _from_files(star.spark, lambda to: files.write_columns(rows, "o_orderkey", _COLUMN_FILES, to, parts=5), read)


_MICRO_ROWS, _MICRO_WIDTHS = 10_000, {"col0": 4, "col1": 8}


def _micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the generated micro table's values, and sums of the other column's."""
    rows = files.micro_table(spark, _MICRO_ROWS)
    return rows.groupBy("col0").agg(F.count(F.lit(1)).alias("n"), F.sum("col1").alias("sum_col1"))


def _micro_files(spark: SparkSession, read: Callable[[str], DataFrame]) -> DataFrame:
    return _from_files(spark, lambda to: files.write_micro_table(files.micro_table(spark, _MICRO_ROWS), "id", _MICRO_WIDTHS, f"{to}/mb_data"), lambda at: read(f"{at}/mb_data"))


def _micro_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The micro table from its meta file and column files."""
    return _micro_files(spark, lambda at: files.read_micro_table(spark, at)[0])


def _micro_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each column of the micro table, packed by the width that its file names."""

    def packed(at: str) -> DataFrame:
        rows, widths = files.read_micro_table(spark, at)
        parts = [encoding.packed(rows, "row", c, w).select(F.lit(c).alias("column_name"), "word_id", "word") for c, w in widths.items()]
        return parts[0].unionByName(parts[1])

    return _micro_files(spark, packed)


def _micro_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column in the engine's own layout, two header lines before the values."""
    rows = files.micro_table(spark, _MICRO_ROWS)
    return _from_files(spark, lambda to: files.write_lines(rows, "id", "col1", [str(_MICRO_ROWS), "256"], f"{to}/mb_col"), lambda at: files.read_micro_column(spark, f"{at}/mb_col", 2))


def _startup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 3.1 by startup parameters, from a script file, every fact row twice."""

    def write(to: str) -> None:
        lines = spark.createDataFrame(list(enumerate(ssb.SCRIPTS["q3_1"].split("\n"))), "at long, line string")
        files.write_lines(lines, "at", "line", [], f"{to}/3_1.txt", 1)

    return _from_files(spark, write, lambda at: execute(spark, parameters.parse([f"data_path:{sf_dir}", f"query_path:{at}/", "q_id:3_1.txt", "sf:2"])))


def _stored(star: Star) -> DataFrame:
    """Query 3.1 over the star that was written as Parquet."""
    return _from_files(star.spark, lambda to: store.write_star(star, to), lambda at: run_script(store.open_star(star, at), ssb.SCRIPTS["q3_1"]))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out |= {n: _star(lambda s, t=t, p=p: _scanned(s, t, p)) for n, (t, p) in _SCANS.items()}
    out |= {f"semi_{d}": _star(lambda s, d=d: _semi(s, (d,))) for d in DIMENSIONS}
    out |= {n: _star(lambda s, q=q: run(s, q)) for n, q in _AGGREGATES.items()}
    out |= {f"ssb_{n}": _star(lambda s, t=t: run_script(s, t)) for n, t in ssb.SCRIPTS.items()}
    out |= {
        "scan_counts": _star(lambda s: scan_counts(s, _COUNTED)),
        "semi_multi": _star(lambda s: _semi(s, DIMENSIONS)),
        "semi_copart": _star(_copart),
        "join_counts": _star(lambda s: join_counts(s, _MULTI)),
        "agg_pre": _star(lambda s: pre_aggregate(s, _AGGREGATES["agg_rev_2key"], ["lo_quantity"])),
        "agg_post": _star(lambda s: post_aggregate(pre_aggregate(s, _AGGREGATES["agg_rev_2key"], ["lo_quantity"]), _AGGREGATES["agg_rev_2key"], _POST)),
        "agg_composite_id": _star(_composite),
        "agg_str_count": _star(lambda s: joined(s, _AGGREGATES["agg_str_key"]).groupBy("p_brand1").agg(F.count(F.lit(1)).alias("n"))),
        "dict_int": _star(lambda s: encoding.dictionary(s.raw("part"), "p_size").select(F.col("code").cast("long").alias("code"), "value")),
        "dict_double": _star(lambda s: encoding.dictionary(s.raw("supplier"), "s_acctbal").select(F.col("code").cast("long").alias("code"), "value")),
        "dict_str": _star(lambda s: encoding.dictionary(s.customer(), "c_nation").select(F.col("code").cast("long").alias("code"), "value")),
        "dict_encode_fk": _star(_encoded_key),
        "dict_decode": _star(lambda s: _decoded(s).withColumn("code", F.col("code").cast("long"))),
        "code_width": _star(lambda s: encoding.widths(s.customer(), ["c_custkey", "c_city", "c_nation", "c_region"])),
        "morsels": _star(lambda s: partitions.morsels(s.raw("orders"), "o_orderkey", PART_ROWS)),
        "morsels_drop_remainder": _star(lambda s: partitions.full_morsels(s.raw("orders"), "o_orderkey", PART_ROWS)),
        "range_partition": _star(lambda s: s.lineorder(["lo_revenue"]).groupBy(partitions.range_of("lo_revenue").alias("range_id")).agg(F.count(F.lit(1)).alias("n"))),
        "copart_split": _star(lambda s: s.raw("orders").select("o_orderkey", *encoding.halves("o_orderkey"))),
        "groupby_map": _star(lambda s: _groupby_map(s).withColumn("group_code", F.col("group_code").cast("long"))),
        "pack_words": _star(_pack),
        "bitmap_scan": _star(lambda s: _map(s, _ASIA)),
        "bitmap_join": _star(_join_map),
        "bitmap_and": _star(lambda s: bitmaps.both(_map(s, _ASIA), _map(s, _SEGMENT))),
        "bitmap_popcount": _star(lambda s: bitmaps.population(_map(s, _ASIA))),
        "bitmap_positions": _star(lambda s: bitmaps.positions(_map(s, _ASIA))),
        "bitmap_probe": _star(_probe),
        "bitmap_print": _star(lambda s: _map(s, _ASIA).select("word_id", bits.shown(F.col("word")).alias("bits"))),
        "token_split": _star(lambda s: s.raw("part").select("p_partkey", F.explode(files.tokens(F.col("p_brand"), "#")).alias("token"))),
        "scale_replay": _star(lambda s: files.replay(s.raw("nation"), 3)),
        "source_delimited": _star(_delimited),
        "source_column_files": _star(_column_files),
        "micro_counts": _micro,
        "micro_table": _micro_table,
        "micro_pack": _micro_pack,
        "micro_engine_column": _micro_engine,
        "startup_run": _startup,
        "stored_star": _star(_stored),
    }
    return out


def _with(select: str) -> str:
    return f"WITH {VIEWS_SQL} {select}"


def _bit(row: str) -> str:
    return f"CASE WHEN {row} % 64 = 0 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (63 - {row} % 64)::INT END"


def _bitmap_sql(holds: str, source: str = "customer_", row: str = "c_custkey") -> str:
    return f"SELECT {row} // 64 AS word_id, bit_or(CASE WHEN {holds} THEN {_bit(row)} ELSE 0 END) AS word FROM {source} GROUP BY 1"


def _semi_sql(names: tuple[str, ...]) -> str:
    columns = ", ".join(dict.fromkeys([*_FACT, *(_JOINS[n] for n in names)]))
    tests = " AND ".join(f"EXISTS (SELECT 1 FROM {n}_ WHERE {key_of(n)} = {_JOINS[n]} AND {_FILTERS[n].sql()})" for n in names)
    return _with(f"SELECT {columns} FROM lineorder WHERE {tests}")


def _count_sql(parts: list[tuple[str, str]]) -> str:
    return _with(" UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS op, count(*) AS matches FROM {body}) WHERE matches > 0" for name, body in parts))


def _where(predicates: list[Predicate]) -> str:
    return " WHERE " + " AND ".join(p.sql() for p in predicates) if predicates else ""


def _dictionary_sql(column: str, source: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY value) - 1 AS code, value FROM (SELECT DISTINCT {column} AS value FROM {source} WHERE {column} IS NOT NULL)"


def _packed_sql(column: str, bits: int, code: str, source: str) -> str:
    """Words as sums of codes; those over the sign bit are negative."""
    per = 64 // bits
    whole = f"sum(CAST({code} AS HUGEINT) << ({64 - bits} - (range % {per}) * {bits})::INT)"
    return f"SELECT '{column}' AS column_name, range // {per} AS word_id, CAST(CASE WHEN {whole} >= 9223372036854775808 THEN {whole} - 18446744073709551616 ELSE {whole} END AS BIGINT) AS word FROM {source} GROUP BY range // {per}"


def oracle_sql() -> dict[str, str]:
    two = _AGGREGATES["agg_rev_2key"]
    asia, segment = _ASIA.sql(), _SEGMENT.sql()
    columns = {"lineorder": ", ".join(_FACT)}
    part = partitions.rounded(PART_ROWS)
    morsel = f"SELECT o_orderkey // {part} AS part_id, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row, count(*) AS n_rows FROM orders GROUP BY 1"
    micro = "CAST(('0x' || substr(md5('{0}:' || range), 1, 8))::BIGINT % {1} AS INTEGER)"
    out = {n: _with(f"SELECT {columns.get(t, '*')} FROM {t}{'' if t == 'lineorder' else '_'}{_where(p)}") for n, (t, p) in _SCANS.items()}
    out |= {f"semi_{d}": _semi_sql((d,)) for d in DIMENSIONS}
    out |= {n: sql(q) for n, q in _AGGREGATES.items()}
    out |= {f"ssb_{n}": sql(parse(t)) for n, t in ssb.SCRIPTS.items()}
    out |= {
        "scan_counts": _count_sql([(f"LO_SCAN{f'_{i + 1}' if i else ''}", f"lineorder WHERE {p.sql()}") for i, p in enumerate(_COUNTED.predicates)] + [(SCANS[d], f"{d}_{_where(_COUNTED.dimensions[d].predicates)}") for d in _COUNTED.dimensions]),
        "semi_multi": _semi_sql(DIMENSIONS),
        "semi_copart": _with(f"SELECT {', '.join(_FACT)} FROM lineorder WHERE EXISTS (SELECT 1 FROM part_ WHERE p_partkey = lo_partkey AND {_FILTERS['part'].sql()})"),
        "join_counts": _count_sql([(JOINS[d], f"lineorder WHERE {_MULTI.joins[d]} IN (SELECT {key_of(d)} FROM {d}_{_where(q.predicates)})") for d, q in _MULTI.dimensions.items()]),
        "agg_pre": _with(f"SELECT {', '.join(two.groups)}, lo_revenue, lo_quantity FROM lineorder JOIN supplier_ ON lo_suppkey = s_suppkey JOIN date_ ON lo_orderdate = d_datekey WHERE {_FILTERS['supplier'].sql()}"),
        "agg_post": sql(two, _POST),
        "agg_composite_id": _with(
            "SELECT CAST((dense_rank() OVER (ORDER BY s_region) - 1) * (SELECT count(DISTINCT d_year) FROM date_) + y.code AS BIGINT) AS id, t.s_region, t.d_year, total FROM ("
            "SELECT s_region, d_year, CAST(sum(lo_revenue) AS BIGINT) AS total FROM lineorder JOIN supplier_ ON lo_suppkey = s_suppkey JOIN date_ ON lo_orderdate = d_datekey GROUP BY ALL) t "
            f"JOIN ({_dictionary_sql('d_year', 'date_')}) y ON y.value = t.d_year"
        ),
        "agg_str_count": _with("SELECT p_brand1, count(*) AS n FROM lineorder JOIN part_ ON lo_partkey = p_partkey" + _where(_AGGREGATES["agg_str_key"].predicates) + " GROUP BY 1"),
        "dict_int": _dictionary_sql("p_size", "part"),
        "dict_double": _dictionary_sql("s_acctbal", "supplier"),
        "dict_str": _with(_dictionary_sql("c_nation", "customer_")),
        "dict_encode_fk": _with(f"SELECT lo_suppkey, code, count(*) AS n FROM lineorder LEFT JOIN ({_dictionary_sql('s_suppkey', 'supplier_')}) ON value = lo_suppkey GROUP BY 1, 2"),
        "dict_decode": _with("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand1) - 1 AS code, p_brand1 FROM part_"),
        "code_width": _with(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) <= 128 THEN 8 WHEN count(DISTINCT {c}) <= 32768 THEN 16 ELSE 32 END AS bits FROM customer_" for c in ("c_custkey", "c_city", "c_nation", "c_region"))),
        "morsels": morsel,
        "morsels_drop_remainder": f"SELECT * FROM ({morsel}) WHERE n_rows = {part}",
        "range_partition": _with("SELECT lo_revenue >> 16 AS range_id, count(*) AS n FROM lineorder GROUP BY 1"),
        "copart_split": "SELECT o_orderkey, o_orderkey >> 16 AS hi, o_orderkey & 65535 AS lo FROM orders",
        "groupby_map": _with("SELECT s_suppkey, dense_rank() OVER (ORDER BY s_nation) - 1 AS group_code FROM supplier_"),
        "pack_words": _with("SELECT c_custkey // 8 AS word_id, CAST(sum(code << (56 - (c_custkey % 8) * 8)) AS BIGINT) AS word FROM (SELECT c_custkey, dense_rank() OVER (ORDER BY c_nation) - 1 AS code FROM customer_) GROUP BY 1"),
        "bitmap_scan": _with(_bitmap_sql(asia)),
        "bitmap_join": _with(_bitmap_sql(f"o_custkey IN (SELECT c_custkey FROM customer_ WHERE {asia})", "orders", "o_orderkey")),
        "bitmap_and": _with(f"SELECT word_id, a.word & b.word AS word FROM ({_bitmap_sql(asia)}) a JOIN ({_bitmap_sql(segment)}) b USING (word_id)"),
        "bitmap_popcount": _with(f"SELECT count(*) AS matches FROM customer_ WHERE {asia}"),
        "bitmap_positions": _with(f"SELECT c_custkey AS row_id FROM customer_ WHERE {asia}"),
        "bitmap_probe": _with(f"SELECT c_custkey, CAST({asia} AS INTEGER) AS bit FROM customer_"),
        "bitmap_print": _with(f"SELECT c_custkey // 64 AS word_id, rpad(string_agg(CASE WHEN {asia} THEN '1' ELSE '0' END, '' ORDER BY c_custkey), 64, '0') AS bits FROM customer_ GROUP BY 1"),
        "token_split": "SELECT p_partkey, unnest(CASE WHEN p_brand LIKE '%#' THEN string_split(p_brand, '#')[:-2] ELSE string_split(p_brand, '#') END) AS token FROM part",
        "scale_replay": "SELECT nation.* FROM nation, range(3)",
        "source_delimited": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
        "source_column_files": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IS NOT NULL",
        "micro_counts": f"SELECT {micro.format(0, 16)} AS col0, count(*) AS n, CAST(sum({micro.format(1, 256)}) AS BIGINT) AS sum_col1 FROM range({_MICRO_ROWS}) GROUP BY 1",
        "micro_table": f"SELECT CAST(range AS BIGINT) AS row, {micro.format(0, 16)} AS col0, {micro.format(1, 256)} AS col1 FROM range({_MICRO_ROWS})",
        "micro_pack": " UNION ALL ".join(_packed_sql(c, w, micro.format(i, 1 << w), f"range({_MICRO_ROWS})") for i, (c, w) in enumerate(_MICRO_WIDTHS.items())),
        "micro_engine_column": f"SELECT CAST(range AS BIGINT) AS row, {micro.format(1, 256)} AS value FROM range({_MICRO_ROWS})",
        "startup_run": f"SELECT * REPLACE (2 * total AS total) FROM ({sql(parse(ssb.SCRIPTS['q3_1']))})",
        "stored_star": sql(parse(ssb.SCRIPTS["q3_1"])),
    }
    return out
