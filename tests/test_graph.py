import math
import random

import numpy as np
import pytest

from ballgraph.operators import community as M
from ballgraph.operators import forest
from ballgraph.operators import graph as G
from ballgraph.operators import layout as Y
from ballgraph.operators.knn import exact_knn, neighbour_lists
from tests.helpers import blobs, column, points_df


@pytest.fixture(scope="module")
def near(spark):
    x, _ = blobs(30, 3, 6, seed=1, spread=1.5)
    return exact_knn(points_df(spark, x), 8).persist()


def test_memberships_sum_to_the_target(spark, near):
    rows = G.smooth_knn(neighbour_lists(near), 8).collect()
    for r in rows:
        total = sum(math.exp(-max(d - r.rho, 0.0) / r.sigma) for d in r.ds)
        assert r.rho == min(r.ds)
        assert abs(total - 3.0) < 1e-5


def test_local_connectivity(spark):
    lists = spark.createDataFrame([(0, [1, 2, 3], [0.0, 1.0, 2.0])], "i bigint, js array<bigint>, ds array<double>")
    rho = lambda **kw: G.smooth_knn(lists, 3, **kw).first().rho
    assert rho() == 0.0
    assert rho(nonzero=True) == 1.0
    assert rho(local_connectivity=1.5) == 0.5
    assert rho(local_connectivity=0.5) == 0.5   # half of the first nonzero distance


def test_ragged_lists(spark):
    rows = [(0, [1, 2, 3], [1.0, 2.0, 3.0]), (1, [0], [1.0])]
    lists = spark.createDataFrame(rows, "i bigint, js array<bigint>, ds array<double>")
    out = {r.i: r for r in G.smooth_knn(lists, 3).collect()}
    assert out[1].sigma == pytest.approx(1e-3) or out[1].sigma > 0
    assert out[0].rho == 1.0


def test_fuzzy_union_of_a_small_graph(spark):
    rows = [(0, 1, 0.5), (1, 0, 0.5), (0, 2, 0.25), (0, 2, 0.25), (3, 3, 1.0), (0, 9, 1.0), (2, 3, 0.0)]
    edges = spark.createDataFrame(rows, "i bigint, j bigint, w double")
    got = {(r.i, r.j): r.w for r in G.fuzzy_union(edges, n=4).collect()}
    assert got == {(0, 1): 0.75, (1, 0): 0.75, (0, 2): 0.5, (2, 0): 0.5}
    ones = {r.w for r in G.fuzzy_union(edges, n=4, binarize=True).collect()}
    assert ones == {1.0}


def test_fuzzy_union_is_symmetric(spark, near):
    union = G.fuzzy_union(G.memberships(G.smooth_knn(neighbour_lists(near), 8)))
    w = {(r.i, r.j): r.w for r in union.collect()}
    assert all(abs(w[(j, i)] - v) < 1e-12 and 0 < v <= 1 for (i, j), v in w.items())


def test_spectral_layout_matches_eigh(spark):
    n = 90
    x = np.random.default_rng(9).uniform(size=(n, 2)) * [3.0, 1.0]
    edges = G.knn_edges(exact_knn(points_df(spark, x), 8)).persist()
    a = np.zeros((n, n))
    for r in G.normalized_adjacency(edges)[0].collect():
        a[r.i, r.j] = r.w
    values, vectors = np.linalg.eigh(a)
    top, gap = vectors[:, ::-1][:, 1:3], values[::-1]
    assert gap[0] - gap[1] > 1e-6, "the graph must be connected for a unique layout"
    points = points_df(spark, np.zeros((n, 1)))
    y = column(Y.spectral_layout(points, edges, n, 2), "y")
    want = top - top.mean(axis=0)
    want = 10.0 * want / want.std(axis=0, ddof=1)
    for c in range(2):
        assert min(np.abs(y[:, c] - want[:, c]).max(), np.abs(y[:, c] + want[:, c]).max()) < 1e-3


def test_spectral_layout_without_edges(spark):
    points = points_df(spark, np.zeros((5, 2)))
    edges = spark.createDataFrame([], "i bigint, j bigint, w double")
    y = column(Y.spectral_layout(points, edges, 5, 2), "y")
    assert y.shape == (5, 2) and np.abs(y).max() < 1e-2


def test_communities_find_separate_blobs(spark):
    x, labels = blobs(30, 3, 6, seed=3)
    near = exact_knn(points_df(spark, x), 6)
    graph = G.fuzzy_union(G.memberships(G.smooth_knn(neighbour_lists(near), 6))).persist()
    found = M.communities(graph)
    c = column(found, "c")
    score = M.modularity(graph, found).first().modularity
    single = M.modularity(graph, found.selectExpr("id", "id as c")).first().modularity
    assert score > 0.6 > single
    for group in np.unique(c):
        assert len(set(labels[c == group])) == 1


def _parts(ids, pairs):
    return {frozenset(g) for g in _groups(ids, pairs)}


def _groups(ids, pairs):
    near = {i: {i} for i in ids}
    for i, j in pairs:
        if near[i] is not near[j]:
            near[i] |= near[j]
            for x in near[j]:
                near[x] = near[i]
    return near.values()


def test_communities_are_connected_and_no_worse_than_before_refinement(spark):
    rng = np.random.default_rng(0)
    group = np.arange(72) // 9
    w = np.triu(np.where(rng.random((72, 72)) < np.where(group[:, None] == group, 0.5, 0.03), rng.integers(1, 4, (72, 72)), 0), 1)
    w = (w + w.T).astype(float)
    w[70, 70] = 2.0
    w[71] = w[:, 71] = 0.0
    w[71, 71] = 1.0  # joined to nobody
    rows = [(i, j, float(w[i, j])) for i, j in zip(*map(lambda x: x.tolist(), np.nonzero(w)))]
    graph = spark.createDataFrame(rows, "i bigint, j bigint, w double").persist()
    found = M.communities(graph)
    c = {r.id: r.c for r in found.collect()}
    assert found.count() == len(c) == len({i for i, _, _ in rows})
    inside = _parts(c, [(i, j) for i, j, _ in rows if c[i] == c[j]])
    assert len(inside) == len({*c.values()})
    before = M.communities(graph, refine=False)
    assert M.modularity(graph, found).first().modularity >= M.modularity(graph, before).first().modularity - 1e-12


def test_refined_parts_are_connected_and_raise_modularity(spark, near):
    graph = G.fuzzy_union(G.memberships(G.smooth_knn(neighbour_lists(near), 8))).persist()
    scratch = M.Scratch(spark, "refine")
    level = M._Level(graph, graph.agg({"w": "sum"}).first()[0], 1.0, scratch, "t")
    one = level.nodes.selectExpr("id", "pmod(id, 2) AS c", "deg")  # communities that mean nothing
    parts = {r.id: (r.c, r.s) for r in M._refine(level, one, scratch, 1, 100, 5).collect()}
    assert {i: c for i, (c, _) in parts.items()} == {i: i % 2 for i in parts}
    s = {i: x for i, (_, x) in parts.items()}
    inside = _parts(s, [(r.i, r.j) for r in graph.collect() if s[r.i] == s[r.j]])
    assert len(inside) == len({*s.values()}) < len(s)
    assert all(len({i % 2 for i in p}) == 1 for p in inside)
    frame = spark.createDataFrame(list(s.items()), "id bigint, c bigint")
    single = frame.selectExpr("id", "id AS c")
    assert M.modularity(graph, frame).first()[0] > M.modularity(graph, single).first()[0]


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_components_match_plain_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(forest, "BROADCAST_BYTES", limit)
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + n, 101 + n) for n in range(20)] + [(5, 5)]
    ids = [*range(60), *range(100, 121)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id bigint")
    found = forest.components(nodes, spark.createDataFrame(pairs, "i bigint, j bigint").repartition(4)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.c, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == _parts(ids, pairs) and len(found) == len(ids)
    assert all(c in g for c, g in groups.items())
    assert forest.components(nodes.limit(0), spark.createDataFrame(pairs, "i bigint, j bigint").limit(0)).count() == 0


def test_communities_of_nothing(spark):
    assert M.communities(spark.createDataFrame([], "i bigint, j bigint, w double")).count() == 0


def _kruskal(edges):
    root, kept = {}, set()

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for g, w, i, j in sorted({(str(g), w, min(i, j), max(i, j)) for g, i, j, w in edges if w is not None and i != j}):
        if top((g, i)) != top((g, j)):
            root[top((g, i))] = top((g, j))
            kept.add((g, i, j, w))
    return kept


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_spanning_forest_matches_kruskal(spark, monkeypatch, limit):
    monkeypatch.setattr(forest, "BROADCAST_BYTES", limit)
    rng = random.Random(9)
    edges = [(g, rng.randrange(40), rng.randrange(40), float(rng.randrange(6))) for g in ("a", "b", None) for _ in range(70)]
    edges += [("path", n, n + 1, float(n % 3)) for n in range(60)] + [("star", 0, n, 1.0) for n in range(1, 30)]
    edges += [("loop", 1, 1, 0.0), ("none", 1, 2, None), ("a", 7, 7, 0.0), ("two", 3, 4, 2.0), ("two", 4, 3, 1.0)]
    table = spark.createDataFrame(edges, "g string, i bigint, j bigint, w double").repartition(5)
    got = [(str(r.g), r.i, r.j, r.w) for r in forest.spanning_forest(table).collect()]
    assert set(got) == _kruskal(edges) and len(got) == len(set(got))
    empty = forest.spanning_forest(table.limit(0))
    assert empty.columns == ["g", "i", "j", "w"] and empty.count() == 0
