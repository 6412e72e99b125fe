"""Star aggregates over a stream of fact rows and static dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellara.plans.script import StarQuery
from stellara.plans.star import joined, measure
from stellara.sources.views import Star


def running(star: Star, query: StarQuery, fact_stream: DataFrame) -> DataFrame:
    """A streaming frame of the totals so far, for complete or update mode; state is one row a group."""
    rows = joined(star, query, fact_stream)
    return rows.groupBy(*query.groups).agg(F.sum(measure(query.measure)).cast("long").alias("total"))
