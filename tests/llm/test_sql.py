"""The queries of the training-data operators beside their SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from corpusloom.llm.queries import QUERIES
from corpusloom.llm.sql import ORACLE

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    # a column of whole numbers with nulls comes as floats from one side
    found = compare(QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).execute(ORACLE[name]).df())
    assert found.startswith("ok")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
