import itertools
import math

import numpy as np
import pytest

from ballgraph.functions import draws
from ballgraph.operators import evaluation as E
from ballgraph.operators import probe as P
from ballgraph.operators import topology as T
from ballgraph.plans.report import evaluate
from tests.helpers import blobs, layout_df, points_df


def _trust(x, z, k):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    e = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    total = 0
    for i in range(n):
        near = [j for j in np.lexsort((np.arange(n), e[i])) if j != i][:k]
        total += sum(max(0, 1 + (np.delete(d[i], i) < d[i, j]).sum() - k) for j in near)
    return 1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * total


@pytest.mark.parametrize("chunk", [4096, 25])
def test_trustworthiness_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(P, "CHUNK_ROWS", chunk)
    x, _ = blobs(30, 3, 5, seed=1)
    x[5] = x[60]
    z = np.random.default_rng(2).normal(size=(90, 2)) + x[:, :2]
    got = E.trustworthiness(points_df(spark, x), layout_df(spark, z), 7).first()[0]
    assert got == pytest.approx(_trust(x, z, 7), abs=1e-12)


def test_trustworthiness_of_itself_is_one(spark):
    x, _ = blobs(20, 2, 3)
    assert E.trustworthiness(points_df(spark, x), layout_df(spark, x), 5).first()[0] == 1.0
    with pytest.raises(ValueError):
        E.trustworthiness(points_df(spark, x), layout_df(spark, x), 20)


def test_procrustes_of_a_rotated_copy_is_one(spark):
    x = np.random.default_rng(0).normal(size=(40, 2))
    turn = np.array([[math.cos(1), -math.sin(1)], [math.sin(1), math.cos(1)]])
    same = E.procrustes_similarity(layout_df(spark, x), layout_df(spark, 3.0 * x @ turn + 5.0), 2)
    assert same == pytest.approx(1.0)
    other = E.procrustes_similarity(
        layout_df(spark, x), layout_df(spark, np.random.default_rng(1).normal(size=(40, 2))), 2
    )
    assert other < 0.5
    with pytest.raises(ValueError):
        E.procrustes_similarity(layout_df(spark, x), layout_df(spark, np.ones((40, 2))), 2)


def test_subsamples_are_whole_and_repeatable(spark):
    points = points_df(spark, np.zeros((100, 1)))
    rows = sorted(map(tuple, E.subsamples(points, 4, 30, 1).collect()))
    assert rows == sorted(map(tuple, E.subsamples(points.repartition(1), 4, 30, 1).collect()))
    per = {r: {i for q, i in rows if q == r} for r in range(4)}
    assert all(len(ids) == 30 for ids in per.values()) and per[0] != per[1]


@pytest.mark.parametrize("margin", [6, -4])
def test_subsamples_are_the_smallest_draws(spark, monkeypatch, margin):
    monkeypatch.setattr(E, "SAMPLE_MARGIN", margin)  # a bound that is too low is raised
    points = points_df(spark, np.zeros((300, 1)))
    u = draws.draw((5, "sample"), "repeat", "id")
    every = points.crossJoin(spark.range(6).selectExpr("cast(id AS int) AS repeat")).selectExpr("repeat", "id", f"{u} AS u")
    ranked = sorted((r.repeat, r.u, r.id) for r in every.collect())
    want = {(g, i) for g in range(6) for _, _, i in [x for x in ranked if x[0] == g][:40]}
    got = [tuple(r) for r in E.subsamples(points, 6, 40, 5).collect()]
    assert set(got) == want and len(got) == 240
    assert E.subsamples(points, 2, 400, 5).count() == 600 and E.subsamples(points.limit(0), 2, 9, 5).count() == 0


def _dist(x):
    return T._distances(np.asarray(x, dtype=float), "euclidean")


def test_unit_square():
    d = _dist([[0, 0], [0, 1], [1, 1], [1, 0]])
    assert T.merge_heights(d).tolist() == [1.0, 1.0, 1.0]
    assert np.allclose(T.loop_bars(d), [[1.0, math.sqrt(2)]])


def test_circle_has_one_long_loop():
    a = np.linspace(0, 2 * np.pi, 20, endpoint=False)
    bars = T.loop_bars(_dist(np.c_[np.cos(a), np.sin(a)]))
    life = bars[:, 1] - bars[:, 0]
    assert (life > 1.0).sum() == 1


def _loops_by_boundary(d):
    """Standard column reduction of the boundary matrix, as an independent answer."""
    m = len(d)
    simplices = [(0.0, 0, (i,)) for i in range(m)]
    simplices += [(d[a, b], 1, (a, b)) for a, b in itertools.combinations(range(m), 2)]
    simplices += [(max(d[a, b], d[a, c], d[b, c]), 2, (a, b, c)) for a, b, c in itertools.combinations(range(m), 3)]
    simplices.sort(key=lambda s: (s[0], s[1], s[2]))
    place = {s[2]: n for n, s in enumerate(simplices)}
    low, bars = {}, []
    for n, (value, dim, s) in enumerate(simplices):
        work = {place[f] for f in itertools.combinations(s, dim)} if dim else set()
        while work and max(work) in low:
            work ^= low[max(work)]
        if work:
            low[max(work)] = work
            birth = simplices[max(work)]
            if dim == 2 and value > birth[0]:
                bars.append((birth[0], value))
    return np.array(sorted(bars)).reshape(-1, 2)


@pytest.mark.parametrize("seed", range(4))
def test_loops_agree_with_boundary_reduction(seed):
    x = np.random.default_rng(seed).normal(size=(14, 2))
    d = _dist(x)
    assert np.allclose(T.loop_bars(d), _loops_by_boundary(d))


def test_merge_heights_are_a_spanning_tree():
    d = _dist(np.random.default_rng(3).normal(size=(30, 3)))
    edges = sorted((d[a, b], a, b) for a, b in itertools.combinations(range(30), 2))
    root, want = list(range(30)), []
    for w, a, b in edges:
        if root[a] != root[b]:
            root = [root[b] if r == root[a] else r for r in root]
            want.append(w)
    assert np.allclose(T.merge_heights(d), want)


def test_line_transport_may_leave_bars_unmatched():
    assert T.line_transport(np.array([0.0]), np.array([0.0, 1.0])) == pytest.approx(1 / math.sqrt(2))
    assert T.line_transport(np.array([1.0, 2.0]), np.array([2.0, 1.0])) == 0.0
    assert T.line_transport(np.array([]), np.array([2.0])) == pytest.approx(math.sqrt(2))


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_optimal(seed):
    cost = np.random.default_rng(seed).uniform(size=(6, 6))
    best = min(sum(cost[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
    assert T.assignment_cost(cost) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(4))
def test_line_transport_agrees_with_assignment(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(size=5), rng.uniform(size=7)
    zero = lambda v: np.c_[np.full(len(v), 1e-300), v]
    exact = T.transport(zero(a), zero(b))
    assert T.line_transport(a, b) == pytest.approx(exact)


def test_report(spark):
    x, _ = blobs(25, 2, 4, seed=5)
    points = points_df(spark, x)
    layouts = {"self": layout_df(spark, x), "flat": layout_df(spark, x[:, :2])}
    got = {(r.method, r.metric): r.value for r in
           evaluate(points, layouts, 5, topo_samples=30, loop_samples=15, repeats=3).collect()}
    assert set(m for _, m in got) == {"trustworthiness", "pca_procrustes", "Wass_H0", "Wass_H1"}
    assert got["self", "trustworthiness"] == 1.0
    assert got["self", "pca_procrustes"] == pytest.approx(1.0)
    assert got["self", "Wass_H0"] == pytest.approx(0.0, abs=1e-9)
    assert got["flat", "Wass_H0"] > 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_component_bars_are_those_of_the_matrix(spark, metric):
    x, _ = blobs(12, 2, 4, seed=8)
    x[3] = x[4]  # a merge at height 0
    samples = T.both_spaces(points_df(spark, x), layout_df(spark, x[:, :2]), 2, 15, 1, metric)
    key = lambda r: (r.repeat, r.space, r.death)
    got = sorted(T.component_bars(samples, metric).collect(), key=key)
    want = sorted(T.diagrams(samples, 0, metric).collect(), key=key)
    assert [(r.repeat, r.space, r.dim, r.birth) for r in got] == [(r.repeat, r.space, r.dim, r.birth) for r in want]
    assert np.allclose([r.death for r in got], [r.death for r in want], atol=1e-6)


def test_an_experiment_scores_its_layouts_in_one_pass(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from ballgraph.operators import evaluation
    from ballgraph.plans import catalog_report, experiment

    x = np.random.default_rng(4).normal(size=(40, 4))
    points = points_df(spark, x)
    at = lambda c: (lambda p, k, seed: p.select("id", F.slice("v", (c + seed) % 3 + 1, 2).alias("y")))
    methods, passes, ranks = {"a": at(0), "b c": at(1)}, [], evaluation.intruder_ranks
    monkeypatch.setattr(evaluation, "intruder_ranks", lambda *a: passes.append(1) or ranks(*a))
    found = experiment.run_experiment(
        {"d": points}, methods, str(tmp_path / "experiment"), [2, 3], [0, 1], ["trustworthiness"], catalog_report.trust_scores
    )
    assert len(passes) == 1  # eight layouts, three of them different
    got = {(r.method, r.k, r.seed): r.value for r in found.cube.collect()}
    assert len(got) == 8
    for (name, k, seed), value in got.items():
        alone = evaluation.trustworthiness(points, methods[name](points, k, seed), 15).first()[0] if k == 2 else got[name, 2, seed]
        assert value == pytest.approx(alone, abs=1e-12)
