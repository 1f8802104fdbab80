"""Every registered query of the engine runs on the small tables, and those with SQL equal DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from versemill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[want.columns.index(c)]) for c in cols)) for r in want.fetchall())
    assert mine == theirs


def test_those_without_sql_have_expected_results():
    with open(os.path.join(os.path.dirname(__file__), "test_expected.py")) as f:
        text = f.read()
    assert all(f'QUERIES["{name}"]' in text for name in set(QUERIES) - set(ORACLES))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
