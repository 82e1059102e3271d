"""Neighbour lists that miss points: nothing may be lost on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballgraph.operators import triangles as R
from ballgraph.operators.graph import _row_sigma
from ballgraph.operators.knn import complete_lists, neighbour_lists
from ballgraph.plans.datasets import cluster_labels
from ballgraph.plans.embed import fit
from ballgraph.session import Scratch
from tests.helpers import points_df


def far_pairs():
    """Six pairs far from each other, and one lonely point."""
    x = []
    for p in range(6):
        centre = np.zeros(8)
        centre[p] = 100.0 * (p + 1)
        x += [centre, centre + 0.01]
    return np.array([*x, np.full(8, -500.0)])


def pair_knn(spark):
    """Each point of a pair is the other's only neighbour."""
    rows = [(i, i ^ 1, 1, 0.03) for i in range(12)]
    return spark.createDataFrame(rows, "i bigint, j bigint, rank int, d double")


@pytest.mark.parametrize("init", ["pca", "spectral", "random"])
def test_fit_keeps_all_points(spark, init):
    out = fit(points_df(spark, far_pairs()), n_neighbors=2, nn_method="lsh", init=init, n_epochs=2, epochs_print=1)
    rows = out.embedding.collect()
    assert sorted(r.id for r in rows) == list(range(13))
    assert np.isfinite(np.array([r.y for r in rows])).all()
    assert all(r.loss > 0 for r in out.log.collect())


def test_discrete_fit_keeps_all_points(spark):
    out = fit(
        points_df(spark, far_pairs()), n_neighbors=2, nn_method="lsh", n_epochs=1, high_dim_cech="discrete",
        low_dim_cech="discrete", use_triplet_weight_in_ce_loss=True,
    )
    assert out.embedding.count() == 13 and out.log.first().loss > 0


def test_labels_of_lonely_points(spark):
    rows = cluster_labels(points_df(spark, far_pairs()), k=2, method="lsh").collect()
    assert sorted(r.id for r in rows) == list(range(13))
    label = {r.id: r.label for r in rows}
    assert all(label[i] == label[i ^ 1] for i in range(12)) and min(label.values()) == 0


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("lonely", [True, False])
def test_all_negatives_are_drawn(spark, exclude, lonely):
    points = points_df(spark, far_pairs())
    near = pair_knn(spark) if lonely else pair_knn(spark).where("i < 4 OR i % 2 = 0")  # some j without a list
    lists = complete_lists(neighbour_lists(near), points)
    ranked, n_sources = R.source_ranks(lists, 13, Scratch(spark, "test"))
    assert n_sources == near.select("i").distinct().count()
    rows = R.negative_triplets(ranked, 13, 50, 50, 1, 1, exclude, n_sources=n_sources).collect()
    js = {r.i: set(r.js) for r in lists.collect()}
    assert sorted(r.slot for r in rows) == list(range(100))
    for r in rows:
        assert len({r.i, r.j, r.k}) == 3 and js[r.i]
        assert (r.j in js[r.i]) == (r.slot >= 50)
        if exclude:
            assert r.k not in js[r.i] | js[r.j]


def test_width_solves_the_sum(spark):
    rng = np.random.default_rng(3)
    d = np.sort(rng.gamma(2.0, [[0.01], [1.0], [300.0]] * 40, (120, 15)), axis=1)
    d[:20, 1:4] = d[:20, :1]
    d[20:30, 6:] = np.inf
    rho = d[:, 0]
    width = _row_sigma(d, rho, np.log2(15))
    total = np.exp(-np.maximum(d - rho[:, None], 0) / width[:, None]).sum(axis=1)
    floor = width <= 1.001e-3 * np.where(np.isfinite(d), d, 0).sum(1) / np.isfinite(d).sum(1)
    assert np.allclose(total[~floor], np.log2(15), rtol=1e-10)
    assert np.isinf(_row_sigma(d[:1, :3], rho[:1], np.log2(15))).all()
