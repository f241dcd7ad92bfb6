"""Every query against its SQL in DuckDB; those without SQL must run and return rows."""

import duckdb
import pytest

from sedimenta.plans import registry
from sedimenta.plans.carriers import TABLES


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    sql = registry.oracle_sql()[name]
    columns = sorted(got.columns)
    assert columns == sorted(duck.sql(sql).columns)
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(repr(plain(r)) for r in duck.sql(f"SELECT {names} FROM ({sql})").fetchall())
    assert sorted(repr(plain(r)) for r in got.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
