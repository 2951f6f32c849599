"""Every query of the core with SQL gives the rows of its SQL."""

import os

import pytest

from quarrylight.plans import registry

from oracle import DATA, spark_rows, sql_rows

SQL = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    df = registry.queries()[name](spark, f"{DATA}/sf0.001")
    assert spark_rows(df) == sql_rows("sf0.001", SQL[name])


def test_names():
    assert set(SQL) <= set(registry.queries())
    assert len(SQL) > 60


def test_flagship(spark):
    df = registry.flagship(spark, f"{DATA}/sf0.001")
    assert {"search_id", "path", "slot"} <= set(df.columns)
    assert df.count() > 0
