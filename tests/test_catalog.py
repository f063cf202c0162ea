"""Every registered query against its SQL, by DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from quillon.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in values), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    c = duck.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in c.description]
    assert got == rows(c.fetchall(), columns)
