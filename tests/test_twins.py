"""Every query of the core that SQL can express gives what the SQL gives."""

from __future__ import annotations

import pytest

from contextframe import plans
from tests.twins import connection, same


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(plans.sql()))
def test_twin(spark, data, con, name):
    same(plans.registered()[name](spark, data), con, plans.sql()[name])


@pytest.mark.parametrize("name", sorted(set(plans.registered()) - set(plans.sql())))
def test_runs(spark, data, name):
    plans.registered()[name](spark, data).collect()
