"""Every query with an SQL equivalent, against DuckDB on the smallest tables."""

import os

import pytest

from resonant import plans
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare(plans.queries()[name](spark, SF), plans.oracle_sql()[name], con) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
