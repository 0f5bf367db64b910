"""Every registered query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

SF = "/root/testdata/sf0.001"
# At the smallest size no model has enough errors to cluster.
LARGER = {name: "/root/testdata/sf0.01" for name in ("error_tfidf", "error_cluster_checks")}
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    sf = LARGER.get(name, SF)
    mine, theirs = QUERIES[name](spark, sf).toPandas(), (connect(sf) if name in LARGER else con).execute(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = canonical(mine), canonical(theirs)
    assert len(a) == len(b) > 0
    for c in a.columns:
        assert a[c].equals(b[c]), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert len(rows) > 0 or name == "error_clusters"
    assert len(set(rows.columns)) == len(rows.columns)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["rank"] for r in rows} == {1, 2}
