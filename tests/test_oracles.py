"""Every tensor query beside its SQL, and the entry module."""

import pytest
from oracle_check import compare, connect

from gridloom import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, con, name):
    said = compare(spark, con, FOLDER, name, queries.queries()[name], queries.oracle_sql()[name])
    assert said is None, said


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - queries.oracle_sql().keys()))
def test_rows(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 64
    assert entry.oracle_sql().keys() <= entry.queries().keys()
