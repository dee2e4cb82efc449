"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from compare import compare, duck

import __spark_entry__ as registered

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_names():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = registered.entry(spark)
    assert "gentrification_score" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    # the smallest scale has no labelled area for the sweep
    sf_dir = "/root/testdata/sf0.01" if name == "threshold_sweep" else SF_DIR
    assert compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir) is None
