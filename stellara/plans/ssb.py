"""The thirteen star schema benchmark queries as scripts, with literals of the provided data."""

from __future__ import annotations

from stellara.plans.script import MEASURES

_FK = {"supplier": "lo_suppkey", "customer": "lo_custkey", "part": "lo_partkey", "date": "lo_orderdate"}


def script(title: str, measure: str, fact: list[str], **dimensions: tuple[list[str], str | None]) -> str:
    lines = [title]
    for name, (predicates, group) in dimensions.items():
        lines += ["START", f"dimension:{name}", *(f"predicates:{p}" for p in predicates), *([f"groupByColumn:{group}"] if group else []), "END"]
    lines += ["START", "fact:lineorder", *(f"predicates:{p}" for p in fact), *(f"join:{d}-{_FK[d]}" for d in dimensions), f"groupByValue:{measure}", "END"]
    return "\n".join(lines)


_REVENUE, _PRODUCT, _PROFIT = MEASURES
_YEARS, _CITIES = ["d_year > 1995 AND d_year <= 1999"], "{0} = NATION_11#6 OR {0} = NATION_11#4"
_MFGRS, _LATE = ["p_mfgr = MFGR#1 OR p_mfgr = MFGR#2"], ["d_year = 1997 OR d_year = 1998"]
_TAKEN = "lo_quantity > 25 AND lo_quantity <= 35"

SCRIPTS = {
    "q1_1": script("Q1.1", _PRODUCT, ["lo_discount > 0 AND lo_discount <= 3", "lo_quantity <= 24"], date=(["d_year = 1996"], None)),
    "q1_2": script("Q1.2", _PRODUCT, ["lo_discount > 3 AND lo_discount <= 6", _TAKEN], date=(["d_yearmonthnum = 199601"], None)),
    "q1_3": script("Q1.3", _PRODUCT, ["lo_discount > 4 AND lo_discount <= 7", _TAKEN], date=(["d_weeknuminyear = 6", "d_year = 1996"], None)),
    "q2_1": script("Q2.1", _REVENUE, [], supplier=(["s_region = AMERICA"], None), part=(["p_category = MFGR#12"], "p_brand1"), date=([], "d_year")),
    "q2_2": script("Q2.2", _REVENUE, [], supplier=(["s_region = ASIA"], None), part=(["p_brand1 > MFGR#2220 AND p_brand1 <= MFGR#2228"], "p_brand1"), date=([], "d_year")),
    "q2_3": script("Q2.3", _REVENUE, [], supplier=(["s_region = EUROPE"], None), part=(["p_brand1 = MFGR#2221"], "p_brand1"), date=([], "d_year")),
    "q3_1": script("Q3.1", _REVENUE, [], supplier=(["s_region = ASIA"], "s_nation"), customer=(["c_region = ASIA"], "c_nation"), date=(_YEARS, "d_year")),
    "q3_2": script("Q3.2", _REVENUE, [], supplier=(["s_nation = NATION_11"], "s_city"), customer=(["c_nation = NATION_11"], "c_city"), date=(_YEARS, "d_year")),
    "q3_3": script("Q3.3", _REVENUE, [], supplier=([_CITIES.format("s_city")], "s_city"), customer=([_CITIES.format("c_city")], "c_city"), date=(_YEARS, "d_year")),
    "q3_4": script("Q3.4", _REVENUE, [], supplier=([_CITIES.format("s_city")], "s_city"), customer=([_CITIES.format("c_city")], "c_city"), date=(["d_yearmonthnum = 199512"], "d_year")),
    "q4_1": script("Q4.1", _PROFIT, [], supplier=(["s_region = AMERICA"], None), customer=(["c_region = AMERICA"], "c_nation"), part=(_MFGRS, None), date=([], "d_year")),
    "q4_2": script("Q4.2", _PROFIT, [], supplier=(["s_region = AMERICA"], "s_nation"), customer=(["c_region = AMERICA"], None), part=(_MFGRS, "p_category"), date=(_LATE, "d_year")),
    "q4_3": script("Q4.3", _PROFIT, [], supplier=(["s_nation = NATION_6"], "s_city"), part=(["p_category = MFGR#14"], "p_brand1"), date=(_LATE, "d_year")),
}
