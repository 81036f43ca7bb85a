"""Every registered query of the engine against its SQL on DuckDB, over the smallest tables."""

import duckdb
import pytest

from eventloom.plans import catalog
from tools.compare import TABLES, rows

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, con, name):
    df = catalog.queries()[name](spark, small)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert len(set(df.columns)) == len(df.columns)
        return
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, res.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
