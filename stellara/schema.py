"""The star: tables, columns, types, keys."""

from __future__ import annotations

from pyspark.sql import types as T

FACT = "lineorder"
#: Dimensions in the order of their table ids, which is the order of group keys: column 0 is the primary key.
DIMENSIONS = ("supplier", "customer", "part", "date")

#: The columns of the star schema benchmark, STRING unless marked :INT.
_COLUMNS = {
    "lineorder": "lo_orderkey:INT lo_linenumber:INT lo_custkey:INT lo_partkey:INT lo_suppkey:INT lo_orderdate:INT lo_orderpriority lo_shippriority:INT lo_quantity:INT lo_extendedprice:INT lo_ordtotalprice:INT lo_discount:INT lo_revenue:INT lo_supplycost:INT",
    "supplier": "s_suppkey:INT s_name s_address s_city s_nation s_region s_phone",
    "customer": "c_custkey:INT c_name c_address c_city c_nation c_region c_phone c_mktsegment",
    "part": "p_partkey:INT p_name p_mfgr p_category p_brand1 p_color p_type p_size:INT p_container",
    "date": "d_datekey:INT d_date d_dayofweek d_month d_year:INT d_yearmonthnum:INT d_yearmonth d_daynuminweek:INT d_daynuminmonth:INT d_daynuminyear:INT d_monthnuminyear:INT d_weeknuminyear:INT d_sellingseason d_lastdayinweekfl:INT d_lastdayinmonthfl:INT d_holidayfl:INT d_weekdayfl:INT",
}
CATALOG: dict[str, dict[str, str]] = {t: {c.split(":")[0]: "INT" if ":" in c else "STRING" for c in cs.split()} for t, cs in _COLUMNS.items()}
#: Measures and keys add up or come from wider keys, so they are 64 bits wide.
_LONG = {"lo_extendedprice", "lo_ordtotalprice", "lo_discount", "lo_revenue", "lo_supplycost", "lo_orderkey", "lo_custkey", "lo_partkey", "lo_suppkey", "s_suppkey", "c_custkey", "p_partkey"}


def table_of(column: str) -> str:
    for name, columns in CATALOG.items():
        if column in columns:
            return name
    raise ValueError(f"no table has the column {column!r}")


def key_of(dimension: str) -> str:
    return next(iter(CATALOG[dimension]))


def struct(name: str) -> T.StructType:
    kinds = {"INT": T.IntegerType(), "STRING": T.StringType()}
    return T.StructType([T.StructField(c, T.LongType() if c in _LONG else kinds[k]) for c, k in CATALOG[name].items()])
