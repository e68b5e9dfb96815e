"""Every registered query of the rule engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from clausegrid import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def shown(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    run = sql.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in run.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
