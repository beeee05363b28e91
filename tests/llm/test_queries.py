"""Registered queries against their SQL, and those without SQL as far as they run."""

from __future__ import annotations

import pytest

from contextframe.llm import queries as Q
from tests.twins import connection, same


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_twin(spark, data, name):
    same(Q.QUERIES[name](spark, data), connection(data), Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))
