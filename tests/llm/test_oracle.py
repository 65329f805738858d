import os

import pytest

from millrace.llm.oracle import ORACLE
from millrace.llm.queries import QUERIES
from tests.helpers import TESTDATA, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    agree(spark, QUERIES[name], ORACLE[name])


def test_columns(spark):
    kinds = {n: QUERIES[n](spark, TESTDATA).dtypes for n in ("p1_found", "p2_found", "p3_found", "p5_found", "p6_ids", "p8_found")}
    assert kinds == {
        "p1_found": [("term", "string"), ("mark", "string")],
        "p2_found": [("docid", "int"), ("term", "string")],
        "p3_found": [("term_a", "string"), ("term_b", "string")],
        "p5_found": [("source", "int"), ("nodeid", "int")],
        "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p8_found": [("doc_id", "bigint")],
    }
