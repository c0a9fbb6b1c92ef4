"""Every registered query against its SQL twin on the smallest data."""

import importlib.util
import os

import duckdb
import pytest

from tesserae.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _module(name, path):
    spec = importlib.util.spec_from_file_location(name, os.path.join(ROOT, path))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


check = _module("check_tool", "tools/check.py")
entry = _module("spark_entry", "__spark_entry__.py")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


#: Reports that may have no rows on tables this small.
MAY_BE_EMPTY: set[str] = {"a26_prefix_counts"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    if name in SQL:
        verdict = check.compare(df, con, SQL[name])
        assert verdict.startswith("ok") or (verdict == "EMPTY" and name in MAY_BE_EMPTY), verdict
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_names_its_columns():
    assert set(SQL) <= set(entry.queries())
