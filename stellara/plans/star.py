"""Star queries as DataFrame plans, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellara.operators.predicates import Predicate, matches, scan
from stellara.plans.script import MEASURES, StarQuery, parse
from stellara.schema import DIMENSIONS, key_of
from stellara.sources.views import VIEWS_SQL, Star

_MEASURE_COLUMNS = {MEASURES[0]: ["lo_revenue"], MEASURES[1]: ["lo_extendedprice", "lo_discount"], MEASURES[2]: ["lo_revenue", "lo_supplycost"]}
#: Names of the operators in count results.
SCANS = {"supplier": "S_SCAN", "customer": "C_SCAN", "part": "P_SCAN", "date": "D_SCAN"}
JOINS = {"supplier": "LS_JOIN", "customer": "LC_JOIN", "part": "LP_JOIN", "date": "LD_JOIN"}


def measure(name: str) -> Column:
    c = [F.col(x) for x in _MEASURE_COLUMNS[name]]
    return c[0] if name == MEASURES[0] else c[0] * c[1] if name == MEASURES[1] else c[0] - c[1]


def needed(query: StarQuery) -> list[str]:
    return list(dict.fromkeys([*query.joins.values(), *(p.column for p in query.predicates), *_MEASURE_COLUMNS[query.measure]]))


def joined(star: Star, query: StarQuery, fact: DataFrame | None = None) -> DataFrame:
    """Fact rows that pass all predicates, with the group attributes: inner joins where an attribute is
    wanted, left-semi joins where only a filter is, no join for a dimension that gives neither.
    The planner broadcasts dimensions by their measured size and shuffles beyond it.

    A filter on dates also goes to the fact's scan, as a range of days; if it is one, and no attribute is wanted, there is no join."""
    spent = None
    if fact is None:
        fact, spent = filtered_fact(star, query, needed(query))
    rows = scan(fact, query.predicates)
    for name in DIMENSIONS:
        d = query.dimensions.get(name)
        if d is None or not (d.group or d.predicates) or (name == spent and not d.group):
            continue
        kept = [key_of(name), *([d.group] if d.group else [])]
        side = scan(star.view(name), d.predicates).select(*kept)
        rows = rows.join(side, F.col(query.joins[name]) == F.col(key_of(name)), "inner" if d.group else "left_semi")
    return rows


def filtered_fact(star: Star, query: StarQuery, columns: list[str]) -> tuple[DataFrame, str | None]:
    """The fact with what the query's filters imply for its scans, and the dimension whose filter that settles."""
    d = query.dimensions.get("date")
    if d is None or not d.predicates or query.joins["date"] != "lo_orderdate":
        return star.lineorder(columns, query.predicates), None
    days = star.days(d.predicates)
    if days is None:
        return star.lineorder(columns, query.predicates).where(F.lit(False)), "date"
    return star.lineorder(columns, query.predicates, days[:2]), "date" if days[2] else None


def aggregated(rows: DataFrame, query: StarQuery) -> DataFrame:
    total = F.sum(measure(query.measure))
    if not query.groups:
        return rows.agg(F.coalesce(total, F.lit(0)).cast("long").alias("total"))
    return rows.groupBy(*query.groups).agg(total.cast("long").alias("total")).orderBy(*query.groups)


def run(star: Star, query: StarQuery, fact: DataFrame | None = None) -> DataFrame:
    """The group attributes, in the order of their tables, and total."""
    return aggregated(joined(star, query, fact), query)


def run_script(star: Star, text: str) -> DataFrame:
    return run(star, parse(text))


def pre_aggregate(star: Star, query: StarQuery, more: list[str]) -> DataFrame:
    """Fact rows after all joins and predicates with what `more` filters need: cache it and use it again."""
    fact = filtered_fact(star, query, [*needed(query), *more])[0]
    return joined(star, query, fact).select(*dict.fromkeys([*query.groups, *_MEASURE_COLUMNS[query.measure], *more]))


def post_aggregate(rows: DataFrame, query: StarQuery, extra: list[Predicate]) -> DataFrame:
    return aggregated(scan(rows, extra), query)


def join_counts(star: Star, query: StarQuery) -> DataFrame:
    """(op, matches): fact rows that each filtered dimension keeps, all in one pass over the fact."""
    rows, marks = star.lineorder(query.joins.values()), {}
    for name in DIMENSIONS:
        if name in query.dimensions:
            side = scan(star.view(name), query.dimensions[name].predicates).select(F.col(key_of(name)), F.lit(True).alias(f"in_{name}"))
            rows = rows.join(side, F.col(query.joins[name]) == F.col(key_of(name)), "left")
            marks[JOINS[name]] = F.count_if(F.col(f"in_{name}"))
    counted = rows.agg(*[c.alias(n) for n, c in marks.items()])
    return unpivoted(counted, list(marks))


def scan_counts(star: Star, query: StarQuery) -> DataFrame:
    """(op, matches) of every scan: the fact's predicates in one pass, then each dimension."""
    out = None
    if query.predicates:
        names = [f"LO_SCAN{f'_{i + 1}' if i else ''}" for i in range(len(query.predicates))]
        fact = star.lineorder(p.column for p in query.predicates)
        out = unpivoted(fact.agg(*[F.count_if(p.on()).alias(n) for n, p in zip(names, query.predicates, strict=True)]), names)
    for name in DIMENSIONS:
        if name in query.dimensions:
            own = matches(star.view(name), query.dimensions[name].predicates, SCANS[name]).where("matches > 0")
            out = own if out is None else out.unionByName(own)
    return out


def unpivoted(row: DataFrame, names: list[str]) -> DataFrame:
    """A row of counts as (op, matches), zero counts left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("op"), F.col(n).alias("matches")) for n in names])
    return row.select(F.explode(pairs).alias("x")).select("x.op", "x.matches").where("matches > 0")


def sql(query: StarQuery, extra: list[Predicate] | None = None) -> str:
    """The same query for the oracle, written as plain joins."""
    joins, where = [], [p.sql() for p in [*query.predicates, *(extra or [])]]
    for name in DIMENSIONS:
        if d := query.dimensions.get(name):
            joins.append(f"JOIN {name}_ ON {query.joins[name]} = {key_of(name)}")
            where += [p.sql() for p in d.predicates]
    keys = ", ".join(query.groups)
    total = f"CAST(coalesce(sum({query.measure}), 0) AS BIGINT) AS total"
    return f"WITH {VIEWS_SQL} SELECT {f'{keys}, ' if keys else ''}{total} FROM lineorder {' '.join(joins)} {'WHERE ' + ' AND '.join(where) if where else ''} {f'GROUP BY {keys}' if keys else ''}"
