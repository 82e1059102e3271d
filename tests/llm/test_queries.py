"""Registered queries with SQL agree with DuckDB on the smallest tables."""

import pytest

from ballgraph.llm import catalog
from tests.compare import DATA, check


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, name):
    ok, note = check(spark, name, f"{DATA}/sf0.001")
    assert ok, note


def test_all_thirteen_and_the_pipeline_are_registered():
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
