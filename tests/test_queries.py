"""All registered queries beside their SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from corpusloom.plans.oracle import ORACLE as SQL
from corpusloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    assert compare(QUERIES[name](spark, FOLDER).toPandas(), tables.execute(SQL[name]).df()) == "ok"


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    assert sorted(set(QUERIES) - set(SQL)) == ["svm_choice", "svm_multiclass_grid", "svm_multilabel"]


def test_flagship_query(spark):
    row = entry.entry(spark).first()
    assert 0 < row["macro_f1"] < 1 and 0 < row["micro_f1"] < 1
