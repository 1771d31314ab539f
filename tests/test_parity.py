"""Every registered query of the domain gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from corrobora.plans import domain, feeds, relational

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES = {**relational.QUERIES, **domain.QUERIES, **feeds.QUERIES}
SQL = {**relational.SQL, **domain.SQL, **feeds.SQL}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return own


def value(x):
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = sorted(repr([value(r[i]) for i in places]) for r in result.fetchall())
    assert sorted(repr([value(r[c]) for c in columns]) for r in df.collect()) == theirs


def test_every_query_has_sql_but_the_drawn_ones():
    assert set(QUERIES) - set(SQL) == {"t7_bootstrap_ci", "b4_cluster_unit_sensitivity", "m10_validate_clustered"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
