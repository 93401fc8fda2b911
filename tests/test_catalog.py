"""Every query of the catalogue against its DuckDB twin, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from muralis.plans import catalog, catalog_canvas, catalog_desk, catalog_graph, catalog_live, catalog_more, catalog_positions, catalog_shapes  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value))
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    # The small tables have fewer suppliers than a gap needs.
    assert rows or name == "largest_gap"
    if name not in catalog.ORACLE_SQL:
        return
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in order) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
