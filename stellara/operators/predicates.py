"""Predicates: one column against one or two literals."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQ, LE, GE, GT, GT_AND_LE, EQ_OR_EQ = "EQ", "LE", "GE", "GT", "GT_AND_LE", "EQ_OR_EQ"


@dataclass(frozen=True)
class Predicate:
    column: str
    kind: str
    values: tuple[int | str, ...]

    def on(self) -> Column:
        c, v = F.col(self.column), self.values
        return {
            EQ: lambda: c == v[0],
            LE: lambda: c <= v[0],
            GE: lambda: c >= v[0],
            GT: lambda: c > v[0],
            GT_AND_LE: lambda: (c > v[0]) & (c <= v[1]),
            EQ_OR_EQ: lambda: c.isin(v[0], v[1]),
        }[self.kind]()

    def bounds(self) -> tuple[float, float]:
        """The least and the greatest value, of numbers, that can pass."""
        v = self.values
        return {
            EQ: lambda: (v[0], v[0]),
            LE: lambda: (-math.inf, v[0]),
            GE: lambda: (v[0], math.inf),
            GT: lambda: (v[0], math.inf),
            GT_AND_LE: lambda: (v[0], v[1]),
            EQ_OR_EQ: lambda: (min(v), max(v)),
        }[self.kind]()

    def holds(self, value: int | str) -> bool:
        v = self.values
        return {
            EQ: lambda: value == v[0],
            LE: lambda: value <= v[0],
            GE: lambda: value >= v[0],
            GT: lambda: value > v[0],
            GT_AND_LE: lambda: v[0] < value <= v[1],
            EQ_OR_EQ: lambda: value in v,
        }[self.kind]()

    def sql(self) -> str:
        v = [x if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in self.values]
        form = {EQ: "{c} = {0}", LE: "{c} <= {0}", GE: "{c} >= {0}", GT: "{c} > {0}", GT_AND_LE: "({c} > {0} AND {c} <= {1})", EQ_OR_EQ: "({c} = {0} OR {c} = {1})"}[self.kind]
        return form.format(*v, c=self.column)

    def __str__(self) -> str:
        return self.sql()


def scan(df: DataFrame, predicates: Iterable[Predicate] = ()) -> DataFrame:
    """All predicates hold; without any, all rows."""
    for p in predicates:
        df = df.where(p.on())
    return df


def matches(df: DataFrame, predicates: Iterable[Predicate], name: str) -> DataFrame:
    """(op, matches) of a scan."""
    return scan(df, predicates).agg(F.count(F.lit(1)).alias("matches")).select(F.lit(name).alias("op"), "matches")
