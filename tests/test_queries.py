"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

from scriptorium.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_spatial_plan_has_no_product(spark):
    """Theta joins stay keyed by document, and the scan reads two columns."""
    plan = catalogue.QUERIES["nearest_node"](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "n_chars" not in plan.split("Physical Plan")[-1]
