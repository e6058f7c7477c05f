"""Every registered query against its SQL."""

import oracle
import pytest

import __spark_entry__ as contract
from barloom.plans.catalog import QUERIES
from barloom.plans.oracles import ORACLES as SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert QUERIES.items() <= contract.queries().items() and SQL.items() <= contract.oracle_sql().items()


UNWANTED = ["PythonUDF", "ArrowEval", "InPandas", "CartesianProduct", "BroadcastNestedLoop"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [node for node in UNWANTED if node in plan] == []
    assert oracle.differences(df, con, SQL[name], tolerance=1.1e-6)[:5] == []


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["Date_Update", "tradingsymbol", "score", "sector", "latest_close"]
    assert 0 < result.count() <= 10
