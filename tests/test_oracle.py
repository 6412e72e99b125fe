"""Every core query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from stellara import queries as core

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SF_DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).itertuples(index=False)))


def test_each_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_sql(spark, duck, name):
    got = core.queries()[name](spark, SF_DIR).toPandas()
    want = duck.sql(core.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 16
    assert set(entry.oracle_sql()) <= set(entry.queries())
