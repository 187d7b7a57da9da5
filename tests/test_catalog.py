"""Every registered query against its DuckDB twin."""

import glob
import os

import duckdb
import pytest

from lumenledger.jobs.registered import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def oracle(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(str(tuple(tidy(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, folder, oracle, name):
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    if name in ORACLE_SQL:
        result = oracle.execute(ORACLE_SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert _rows(df.columns, rows) == _rows(names, result.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
