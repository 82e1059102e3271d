import pytest

import __spark_entry__ as contract
from ballgraph.plans import catalog
from tests.compare import DATA, check

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, name):
    ok, note = check(spark, name, FOLDER)
    assert ok, note


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["id", "y0", "y1"]
    assert df.count() == 500


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


class Called(Exception):
    """Carries the options that a query passes to an operator."""


@pytest.mark.parametrize("name, place, operator, allowed", [
    ("q_spectral", "catalog_graph.Y", "spectral_layout", set()),
    ("q_knn_nndescent", "catalog_graph", "knn_by", set()),
    ("q_pq_encode", "catalog_graph.I", "train_codebooks", set()),
    ("q_knn_ivfpq_all_refined", "catalog_graph", "knn_by", {"n_lists", "n_probe", "refine"}),
    ("q_embed", "catalog_fit", "fit", set()),
    ("q_fit_log", "catalog_fit", "fit", set()),
    ("q_report", "catalog_report", "evaluate", set()),
])
def test_queries_run_the_defaults(spark, monkeypatch, name, place, operator, allowed):
    def record(*args, **options):
        raise Called(options)

    monkeypatch.setattr(f"ballgraph.plans.{place}.{operator}", record)
    with pytest.raises(Called) as found:
        catalog.QUERIES[name](spark, FOLDER)
    assert set(found.value.args[0]) <= allowed
