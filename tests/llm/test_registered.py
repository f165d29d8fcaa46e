"""The registered corpus queries against their SQL twins."""

import pytest

from saleslens.llm import queries as llm

from ..compare import difference


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert difference(llm.QUERIES[name](spark, sf_dir), llm.ORACLE_SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert llm.QUERIES[name](spark, sf_dir).count() > 0
