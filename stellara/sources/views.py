"""The star views over the provided Parquet tables.

The date dimension is a calendar (CALENDAR unless another one is given): making it reads no table, and filters on it
are ranges of days, which go to the scan of orders. An order outside the calendar joins no date.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stellara.operators.predicates import Predicate
from stellara.schema import CATALOG, DIMENSIONS, FACT

#: First and last day of the date dimension.
CALENDAR = (date(1992, 1, 1), date(2011, 12, 31))

#: Fact columns that come from orders or part; the others are lineitem's own.
_ORDER_COLUMNS = {"lo_custkey", "lo_orderdate", "lo_orderpriority", "lo_ordtotalprice"}
_PART_COLUMNS = {"lo_supplycost"}
#: Fact columns that are a rounded multiple of a stored one.
_SCALED = {"lo_quantity": ("l_quantity", 1), "lo_extendedprice": ("l_extendedprice", 100), "lo_discount": ("l_discount", 100), "lo_ordtotalprice": ("o_totalprice", 100)}
FACT_COLUMNS = ("lo_orderkey", "lo_linenumber", "lo_custkey", "lo_partkey", "lo_suppkey", "lo_orderdate", "lo_orderpriority", "lo_shippriority", "lo_quantity", "lo_extendedprice", "lo_ordtotalprice", "lo_discount", "lo_revenue", "lo_supplycost")


def datekey(ts: Column) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def cents(c: str, factor: int = 100) -> Column:
    return F.round(F.col(c) * factor).cast("long")


_schemas: dict[tuple[str, int, int], StructType] = {}


def schema_of(spark: SparkSession, path: str) -> StructType:
    """A table's schema, read from its files once as long as they don't change: each reading is a job of its own."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _schemas:
        if len(_schemas) >= 1000:
            _schemas.clear()
        _schemas[key] = spark.read.parquet(path).schema
    return _schemas[key]


def attributes(day: date) -> dict[str, int]:
    """The date dimension's row of a day."""
    n = day.timetuple().tm_yday
    return {"d_datekey": day.year * 10_000 + day.month * 100 + day.day, "d_year": day.year, "d_monthnuminyear": day.month, "d_yearmonthnum": day.year * 100 + day.month, "d_daynuminyear": n, "d_weeknuminyear": (n - 1) // 7 + 1}


class Star:
    """Views by name. The fact view joins only the tables that the wanted columns need: those joins
    are left joins to primary keys, so leaving one out changes no row."""

    def __init__(self, spark: SparkSession, sf_dir: str, calendar: tuple[date, date] = CALENDAR):
        self.spark, self.sf_dir, self.calendar = spark, sf_dir, calendar

    def days(self, predicates: Iterable[Predicate]) -> tuple[date, date, bool] | None:
        """First and last day of the calendar that pass, and whether all between do; None if no day does."""
        first, last = self.calendar
        every = [first + timedelta(n) for n in range((last - first).days + 1)]
        passed = [d for d in every if all(p.holds(attributes(d)[p.column]) for p in predicates)]
        return (passed[0], passed[-1], (passed[-1] - passed[0]).days + 1 == len(passed)) if passed else None

    def raw(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        return self.spark.read.schema(schema_of(self.spark, path)).parquet(path)

    def view(self, name: str) -> DataFrame:
        return {"supplier": self.supplier, "customer": self.customer, "part": self.part, "date": self.date}[name]()

    def lineorder(self, columns: Iterable[str], filters: Iterable[Predicate] = (), between: tuple[date, date] | None = None) -> DataFrame:
        """The fact. What `filters` on its columns and the days `between` (both included) imply for stored columns goes to
        the scans; the filters themselves are still to be applied."""
        wanted = list(dict.fromkeys(columns))
        if unknown := set(wanted) - set(CATALOG["lineorder"]):
            raise ValueError(f"lineorder has no {sorted(unknown)}")
        rows = self.raw("lineitem")
        for p in filters:
            if p.column in _SCALED and _SCALED[p.column][0].startswith("l_"):
                rows = implied(rows, p)
        if _ORDER_COLUMNS & set(wanted) or between:
            orders = self.raw("orders")
            for p in filters:
                if p.column in _SCALED and _SCALED[p.column][0].startswith("o_"):
                    orders = implied(orders, p)
            narrow = between or any(p.column in _ORDER_COLUMNS for p in filters)
            if between:
                orders = orders.where((F.col("o_orderdate") >= F.lit(between[0]).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(between[1] + timedelta(1)).cast("timestamp_ntz")))
            rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner" if narrow else "left")
        if _PART_COLUMNS & set(wanted):
            rows = rows.join(self.raw("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"), "left")
        price, discount = cents("l_extendedprice"), cents("l_discount")
        made = {
            "lo_orderkey": lambda: F.col("l_orderkey"), "lo_linenumber": lambda: F.col("l_linenumber"), "lo_custkey": lambda: F.col("o_custkey"), "lo_partkey": lambda: F.col("l_partkey"), "lo_suppkey": lambda: F.col("l_suppkey"),
            "lo_orderdate": lambda: datekey(F.col("o_orderdate")), "lo_orderpriority": lambda: F.col("o_orderpriority"), "lo_shippriority": lambda: F.lit(0),
            "lo_quantity": lambda: F.col("l_quantity").cast("int"), "lo_extendedprice": lambda: price, "lo_ordtotalprice": lambda: cents("o_totalprice"), "lo_discount": lambda: discount,
            "lo_revenue": lambda: price * (F.lit(100) - discount), "lo_supplycost": lambda: cents("p_retailprice", 60) * 100,
        }
        return rows.select(*[made[c]().alias(c) for c in wanted])

    def _placed(self, name: str, p: str) -> DataFrame:
        places = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
        key = "suppkey" if p == "s" else "custkey"
        rows = self.raw(name).join(places, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        city = F.concat("n_name", F.lit("#"), (F.col(f"{p}_{key}") % 10).cast("string"))
        own = [F.col("c_mktsegment")] if p == "c" else []
        return rows.select(f"{p}_{key}", f"{p}_name", city.alias(f"{p}_city"), F.col("n_name").alias(f"{p}_nation"), F.col("r_name").alias(f"{p}_region"), *own)

    def supplier(self) -> DataFrame:
        return self._placed("supplier", "s")

    def customer(self) -> DataFrame:
        return self._placed("customer", "c")

    def part(self) -> DataFrame:
        n = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int") - 1
        mfgr = F.concat(F.lit("MFGR#"), (F.floor(n / 5) + 1).cast("string"))
        category = F.concat(mfgr, (n % 5 + 1).cast("string"))
        brand = F.concat(category, F.lpad(F.col("p_size").cast("string"), 2, "0"))
        return self.raw("part").select("p_partkey", "p_name", mfgr.alias("p_mfgr"), category.alias("p_category"), brand.alias("p_brand1"), "p_type", "p_size")

    def date(self) -> DataFrame:
        first, last = self.calendar
        day = self.spark.range(0, (last - first).days + 1, 1, 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("d"))
        d = F.col("d")
        return day.select(datekey(d).alias("d_datekey"), F.year(d).alias("d_year"), F.month(d).alias("d_monthnuminyear"), (F.year(d) * 100 + F.month(d)).alias("d_yearmonthnum"), F.dayofyear(d).alias("d_daynuminyear"), (F.floor((F.dayofyear(d) - 1) / 7) + 1).cast("int").alias("d_weeknuminyear"))


def implied(rows: DataFrame, p: Predicate) -> DataFrame:
    """Rows whose stored column may pass a filter on its rounded multiple: a step to each side more, for rounding."""
    stored, factor = _SCALED[p.column]
    low, high = p.bounds()
    if low > -math.inf:
        rows = rows.where(F.col(stored) >= F.lit(float(low - 1) / factor))
    if high < math.inf:
        rows = rows.where(F.col(stored) <= F.lit(float(high + 1) / factor))
    return rows


class Stored(Star):
    """The star from one table a view, the fact in a folder a year."""

    def __init__(self, spark: SparkSession, folder: str, year: str):
        super().__init__(spark, folder)
        self.year = year

    def view(self, name: str) -> DataFrame:
        if name not in DIMENSIONS:
            raise ValueError(f"unknown dimension {name!r}")
        return self.raw(name)

    def lineorder(self, columns: Iterable[str], filters: Iterable[Predicate] = (), between: tuple[date, date] | None = None) -> DataFrame:
        wanted = list(dict.fromkeys(columns))
        if unknown := set(wanted) - set(CATALOG[FACT]):
            raise ValueError(f"lineorder has no {sorted(unknown)}")
        rows = self.raw(FACT)
        if between:
            first, last = (attributes(d)["d_datekey"] for d in between)
            rows = rows.where(F.col(self.year).between(between[0].year, between[1].year) & F.col("lo_orderdate").between(first, last))
        return rows.select(*wanted)


#: The same views as SQL for the oracle.
VIEWS_SQL = """
lineorder AS (
  SELECT l_orderkey AS lo_orderkey, l_linenumber AS lo_linenumber, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
         CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS lo_orderdate,
         o_orderpriority AS lo_orderpriority, CAST(l_quantity AS INTEGER) AS lo_quantity,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS lo_extendedprice, CAST(round(l_discount * 100) AS BIGINT) AS lo_discount,
         CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS lo_revenue,
         CAST(round(p.p_retailprice * 60) AS BIGINT) * 100 AS lo_supplycost
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN main.part p ON l_partkey = p.p_partkey),
supplier_ AS (
  SELECT s_suppkey, s_name, n_name || '#' || (s_suppkey % 10) AS s_city, n_name AS s_nation, r_name AS s_region
  FROM main.supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
customer_ AS (
  SELECT c_custkey, c_name, n_name || '#' || (c_custkey % 10) AS c_city, n_name AS c_nation, r_name AS c_region, c_mktsegment
  FROM main.customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
part_ AS (
  SELECT p_partkey, p_name, 'MFGR#' || (1 + n // 5) AS p_mfgr, 'MFGR#' || (1 + n // 5) || (1 + n % 5) AS p_category,
         'MFGR#' || (1 + n // 5) || (1 + n % 5) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS p_brand1, p_type, p_size
  FROM (SELECT *, CAST(split_part(p_brand, '#', 2) AS INTEGER) - 1 AS n FROM main.part)),
date_ AS (
  SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS d_datekey,
         CAST(year(d) AS INTEGER) AS d_year, CAST(month(d) AS INTEGER) AS d_monthnuminyear,
         CAST(year(d) * 100 + month(d) AS INTEGER) AS d_yearmonthnum, CAST(dayofyear(d) AS INTEGER) AS d_daynuminyear,
         CAST(1 + (dayofyear(d) - 1) // 7 AS INTEGER) AS d_weeknuminyear
  FROM generate_series(DATE '1992-01-01', DATE '2011-12-31', INTERVAL 1 DAY) AS calendar(d))
"""
