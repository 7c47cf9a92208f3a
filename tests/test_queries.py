"""Every registered query against its SQL."""

import pytest

from lexispark.plans import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_and_sql_agree(spark, name):
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.001") > 0
