import os

import pytest

from millrace.oracle import ORACLE
from millrace.queries import QUERIES
from tests.helpers import TESTDATA, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="needs the test tables")


def test_oracle_covers_known_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    agree(spark, QUERIES[name], ORACLE[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10
