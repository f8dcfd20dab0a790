"""Every registered query against its DuckDB form on the smallest tables."""

import math
from pathlib import Path

import pytest

from lakeloom import queries as Q
from lakeloom import queries_plans  # noqa: F401  registers more

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: (None if math.isnan(v) else repr(round(v, 9) + 0.0)) if isinstance(v, float) else repr(v)
    return sorted(tuple(str(value(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, DATA)
    want = duck.sql(Q.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
