"""Every query with SQL against DuckDB, at the smallest scale."""

import duckdb
import pytest

from treeline.registry import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return str(v).lower() if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, db, name):
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = db.sql(SQL[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[k]) for k in places) for r in relation.fetchall())


def test_all_queries_have_sql_or_say_why():
    assert set(registry.queries()) == set(SQL)
