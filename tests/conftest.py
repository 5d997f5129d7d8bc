import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluates one expression over rows of one column ``x``."""

    def run(items, kind, expression):
        rows = [(i, x) for i, x in enumerate(items)]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        return [r[1] for r in sorted(df.select("i", expression.alias("y")).collect())]

    return run
