"""Every query with SQL returns the rows that DuckDB returns, on the smallest test tables; the others
return rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from chronolock import catalog
from chronolock.plans import composites, core, files, rollup, sequence, shapes, signal  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return (0, 0)
    return (1, float(x)) if isinstance(x, bool | int | float) else (2, str(x))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got
    if name in catalog.ORACLE:
        cur = duck.execute(catalog.ORACLE[name])
        there = [d[0] for d in cur.description]
        assert sorted(there) == names
        rows = [dict(zip(there, r)) for r in cur.fetchall()]
        want = sorted(tuple(plain(r[c]) for c in names) for r in rows)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert all(x == y or x[0] == y[0] == 1 and abs(x[1] - y[1]) <= 1e-9 * max(1, abs(x[1])) for x, y in zip(a, b)), (a, b)


def test_entry_point_runs_without_the_corpus_part(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_every_order_is_a_node(spark):
    from chronolock.catalog import table, view

    for sf in (SF, "/root/testdata/sf0.01"):  # trees of 75 and of 750 nodes
        assert view(spark, sf, "nodes").count() == table(spark, sf, "orders").count()
