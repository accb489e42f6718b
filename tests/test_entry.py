"""The driver contract and the SQL oracle of every registered query (on the smallest scale)."""

import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    df = _entry().entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "column_name" in df.columns


def test_queries_and_oracles_align():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90


def _q_names():
    return sorted(_entry().oracle_sql())


@pytest.mark.parametrize("name", _q_names())
def test_query_matches_oracle(spark, sf_dir, name):
    import sys
    sys.path.insert(0, os.path.join(ROOT, "tests"))
    from oracle_compare import compare, duck
    m = _entry()
    con = duck(sf_dir)
    r = compare(spark, con, name, m.queries()[name], m.oracle_sql()[name], sf_dir)
    assert r["ok"], r
