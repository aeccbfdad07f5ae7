import pytest

from quarryglass.llm.queries import CATALOG
from tests.parity import check, connection


@pytest.fixture(scope="module")
def sql(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(CATALOG.sql))
def test_spark_agrees_with_sql(spark, sql, data, name):
    check(spark, sql, data, CATALOG.runs[name], CATALOG.sql[name])


@pytest.mark.parametrize("name", sorted(set(CATALOG.runs) - set(CATALOG.sql)))
def test_runs_without_sql(spark, data, name):
    df = CATALOG.runs[name](spark, data)
    assert df.columns and df.count() >= 0
