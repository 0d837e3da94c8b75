"""No operator leaves a setting of the session changed."""

import pytest

from quern.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_settings_stay(spark, name):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    assert QUERIES[name](spark, FOLDER).count() > 0
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before
