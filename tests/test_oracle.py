"""Every registered query agrees with its SQL on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
import check_oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return check_oracle.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_agrees_with_sql(spark, con, name):
    assert check_oracle.compare(spark, con, name, FOLDER) == ""


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["l_linestatus", "l_linenumber", "l_returnflag", "y"]
    assert df.count() > 0
