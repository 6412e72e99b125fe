"""Query scripts: text to a star query.

Line 1 is a title. START and END delimit a relation; between them are key:value lines: dimension, fact,
predicates (repeatable), groupByColumn, groupByValue, join (dim-fk, repeatable, of the fact).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from stellara.operators.predicates import EQ, EQ_OR_EQ, GE, GT, GT_AND_LE, LE, Predicate
from stellara.schema import CATALOG, DIMENSIONS, FACT, table_of

MEASURES = ("lo_revenue", "lo_extendedprice*lo_discount", "lo_revenue-lo_supplycost")
_TERM = re.compile(r"^\s*(\w+)\s*(<=|>=|=|>)\s*(.*?)\s*$")
_SIMPLE = {"=": EQ, "<=": LE, ">=": GE, ">": GT}


@dataclass
class Dimension:
    table: str
    predicates: list[Predicate] = field(default_factory=list)
    group: str | None = None


@dataclass
class StarQuery:
    title: str = ""
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    predicates: list[Predicate] = field(default_factory=list)
    joins: dict[str, str] = field(default_factory=dict)
    measure: str = MEASURES[0]

    @property
    def groups(self) -> list[str]:
        return [d.group for t in DIMENSIONS if (d := self.dimensions.get(t)) and d.group]


def literal(column: str, text: str) -> int | str:
    text = text.strip().strip("'")
    if CATALOG[table_of(column)][column] == "STRING":
        return text
    try:
        return int(text)
    except ValueError:
        raise ValueError(f"{column} is a number; {text!r} isn't") from None


def parse_predicate(text: str) -> Predicate:
    """`c = v`, `c <= v`, `c >= v`, `c > v`, `c > a AND c <= b`, `c = a OR c = b`."""
    parts = re.split(r"\s+(AND|OR)\s+", text.strip())
    terms = [_TERM.match(p) for p in parts[::2]]
    if len(parts) not in (1, 3) or not all(terms) or len({t[1] for t in terms if t}) != 1:
        raise ValueError(f"no predicate: {text!r}")
    column, signs = terms[0][1], [t[2] for t in terms]
    values = tuple(literal(column, t[3]) for t in terms)
    if len(parts) == 1:
        return Predicate(column, _SIMPLE[signs[0]], values)
    kinds = {("AND", ">", "<="): GT_AND_LE, ("OR", "=", "="): EQ_OR_EQ}
    if (parts[1], *signs) not in kinds:
        raise ValueError(f"no predicate: {text!r}")
    return Predicate(column, kinds[parts[1], signs[0], signs[1]], values)


def parse(text: str) -> StarQuery:
    title, *lines = text.strip("\n").split("\n")
    query, block = StarQuery(title.strip()), None
    for line in lines:
        line = line.strip()
        if line == "START":
            if block is not None:
                raise ValueError("START inside a relation")
            block = {"predicates": [], "join": []}
        elif line == "END":
            if block is None:
                raise ValueError("END without START")
            _add(query, block)
            block = None
        elif line:
            key, colon, value = line.partition(":")
            if block is None or not colon:
                raise ValueError(f"not inside a relation, or no key:value line: {line!r}")
            if key in ("predicates", "join"):
                block[key].append(value.strip())
            elif key in ("dimension", "fact", "groupByColumn", "groupByValue"):
                block[key] = value.strip()
            else:
                raise ValueError(f"unknown key {key!r}")
    if block is not None:
        raise ValueError("START without END")
    if lost := set(query.dimensions) - set(query.joins):
        raise ValueError(f"no join for {sorted(lost)}")
    if lost := set(query.joins) - set(query.dimensions):
        raise ValueError(f"joins without a relation: {sorted(lost)}")
    return query


def _add(query: StarQuery, block: dict) -> None:
    name = block.get("dimension", block.get("fact"))
    predicates = [parse_predicate(p) for p in block["predicates"]]
    for column in [p.column for p in predicates] + [block[k] for k in ("groupByColumn",) if k in block]:
        if table_of(column) != name:
            raise ValueError(f"{column} isn't a column of {name}")
    if "dimension" in block:
        if name not in DIMENSIONS:
            raise ValueError(f"unknown dimension {name!r}")
        query.dimensions[name] = Dimension(name, predicates, block.get("groupByColumn"))
        return
    if name != FACT:
        raise ValueError(f"unknown fact table {name!r}")
    query.predicates = predicates
    for join in block["join"]:
        dimension, dash, key = join.partition("-")
        if not dash or dimension not in DIMENSIONS or key not in CATALOG[FACT]:
            raise ValueError(f"no join: {join!r}")
        query.joins[dimension] = key
    query.measure = block.get("groupByValue", MEASURES[0]).replace(" ", "")
    if query.measure not in MEASURES:
        raise ValueError(f"unknown measure {query.measure!r}")
