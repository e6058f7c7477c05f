"""Registered queries against their SQL, and the plans of those that must stay native."""

import oracle
import pytest

from barloom.llm.queries import QUERIES
from barloom.llm.sql import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_queries_are_numbered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert oracle.differences(QUERIES[name](spark, sf_dir), con, ORACLES[name])[:5] == []


@pytest.mark.parametrize("name", ["op1_url_filter", "op7_content_sort", "op11_chat_format"])
def test_native(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if node in plan]
