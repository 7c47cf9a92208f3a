"""Queries of the operators against their SQL."""

import pytest

from lexispark.llm import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_and_sql_agree(spark, name, sf):
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], f"/root/testdata/{sf}")
