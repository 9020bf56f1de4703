"""Every query beside its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not there")
@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name not in ORACLES:
        assert df.columns
        return
    assert compare(name, df, con, ORACLES[name]) is None


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns[:2] == ["tenant_id", "instrument"]
