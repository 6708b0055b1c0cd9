"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from workload import catalog, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMOKE_DIR}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.statements())
    assert set(catalog.QUERIES) <= set(queries()) and set(oracle.statements()) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, duck):
    df = queries()[name](spark, SMOKE_DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(oracle_sql()[name])
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert sorted(kinds) == columns
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    order = [list(kinds).index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    found = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert found == expected


def test_entry(spark):
    assert entry(spark).count() > 0
