"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from corpuswright.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    sql = catalogue.ORACLE_SQL[name]
    assert columns == sorted(duck.sql(sql).columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert plain(df.select(*(f"`{c}`" for c in columns)).collect()) == plain(duck.sql(f"SELECT {listed} FROM ({sql})").fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
