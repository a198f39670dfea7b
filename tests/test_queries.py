"""Every registered query with SQL against DuckDB, names, types and values."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodestream.plans.registry import ORACLE_SQL, QUERIES
from lodestream.sources.tables import TABLES

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def rows_of(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    for column, kind in got.dtypes:
        assert SPARK_TO_DUCK.get(kind, kind.upper()) == types[column], column
    order = sorted(got.columns)
    place = [want.columns.index(c) for c in order]
    assert rows_of(got.select(*order).collect()) == rows_of([tuple(r[i] for i in place) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, check=True)
