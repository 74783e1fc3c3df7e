"""Every query of the engine that has SQL gives DuckDB's rows."""

import duckdb
import pytest

from evenkeel.plans import catalogue, public_checks  # noqa: F401  which registers its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name in catalogue.ORACLE_SQL:
        cur = con.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cur.fetchall()) == rows


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
