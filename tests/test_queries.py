import os

import pytest

import __spark_entry__ as entry
from sparkronym import queries as own
from sparkronym import queries_files as files
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = own.QUERIES | files.QUERIES, own.ORACLE | files.ORACLE
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_like_oracle(spark, name):
    same(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
