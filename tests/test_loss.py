import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballgraph.functions import kernels
from ballgraph.operators import cech as C
from ballgraph.operators import loss as O
from ballgraph.operators.discrete_loss import discrete_gradient_rows, layout_packs
from tests.helpers import layout_df, points_df


def _radii(spark, sides, **kw):
    df = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(sides)], "id int, a double, b double, c double")
    r = F.expr(kernels.ball_radius("a", "b", "c", **kw))
    staged = kernels.with_ball(df, kw.get("soft", True), kw.get("beta", 10.0)).orderBy("id").collect()
    direct = [x.r for x in df.withColumn("r", r).orderBy("id").collect()]
    assert np.allclose(direct, [x.R_ for x in staged])
    return direct


SIDES = [(1, 1, 1), (3, 4, 5), (1, 1, 2), (0, 1, 1), (0, 0, 0), (5, 3, 4)]


def test_radius_of_known_triangles(spark):
    hard = _radii(spark, SIDES, soft=False)
    assert np.allclose(hard, [1 / math.sqrt(3), 2.5, 1.0, 0.5, 0.0, 2.5])
    soft = _radii(spark, SIDES, soft=True, beta=10.0)
    assert soft[0] == pytest.approx(1 / math.sqrt(3))
    assert soft[1] == pytest.approx(2.50000227, abs=1e-8)
    assert soft[4] == pytest.approx(math.log(3) / 20)


def test_task_radius_agrees_with_the_expression(spark):
    sides = np.random.default_rng(0).uniform(0.1, 3, size=(60, 3)).tolist() + SIDES
    for soft in (True, False):
        a, b, c = np.array(sides, dtype=float).T
        assert np.allclose(_radii(spark, sides, soft=soft), C.ball_radius_rows(a, b, c, soft, 10.0))


def test_large_sides_do_not_overflow(spark):
    assert _radii(spark, [(1000.0, 1.0, 1000.5)], soft=True) == pytest.approx([500.25], rel=1e-2)


@pytest.mark.parametrize("bad", ["cauchy", ""])
def test_unknown_kernel(bad):
    with pytest.raises(ValueError):
        kernels.phi("r", bad)


def _scene(spark, seed=0, n=12, m=40):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, 2))
    rows = []
    for t in range(m):
        i, j, k = rng.choice(n, 3, replace=False)
        rows.append((int(i), int(j), int(k), float(rng.uniform(0.1, 1)), bool(t % 2)))
    return y, spark.createDataFrame(rows, "i bigint, j bigint, k bigint, w double, positive boolean").persist()


def _loss(spark, y, rows, **kw):
    placed = O.place(rows, O.widen(layout_df(spark, y), 2), 2, True)
    losses = O.triangle_losses(placed, **kw)
    return losses


@pytest.mark.parametrize("phi, soft", [("student", True), ("student", False), ("exp", True)])
def test_gradient_equals_finite_differences(spark, phi, soft):
    y, rows = _scene(spark)
    kw = dict(phi=phi, tau=0.7, gamma=0.5, soft=soft)
    grads = {r.id: (r.g0, r.g1) for r in O.gradients(_loss(spark, y, rows, **kw), 2, 20).collect()}
    h = 1e-6
    for v, c in ((0, 0), (3, 1), (7, 0)):
        ends = []
        for s in (h, -h):
            z = y.copy()
            z[v, c] += s
            ends.append(O.mean_loss(_loss(spark, z, rows, **kw), 20).first().loss)
        assert grads[v][c] == pytest.approx((ends[0] - ends[1]) / (2 * h), rel=1e-5, abs=1e-8)


def test_booked_losses_add_up(spark):
    y, rows = _scene(spark, 1)
    losses = _loss(spark, y, rows)
    total = O.mean_loss(losses, 20).first().loss
    assert O.gradients(losses, 2, 20).agg(F.sum("loss")).first()[0] == pytest.approx(total)


def test_points_in_one_place_have_no_gradient(spark):
    _, rows = _scene(spark)
    grads = O.gradients(_loss(spark, np.zeros((12, 2)), rows.where("positive")), 2, 20).collect()
    assert all(r.g0 == 0.0 and r.g1 == 0.0 for r in grads)


def test_gradient_needs_one_shuffle_of_triangles(spark):
    y, rows = _scene(spark)
    grads = O.gradients(_loss(spark, y, rows), 2, 20)
    grads.collect()
    plan = grads._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning(id") == 1


def test_discrete_gradient_equals_finite_differences(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=(10, 2))
    lists = spark.createDataFrame(
        [(i, [int(j) for j in rng.choice([x for x in range(10) if x != i], 3, replace=False)]) for i in range(10)],
        "i bigint, js array<bigint>",
    ).persist()
    rows = spark.createDataFrame(
        [(0, 1, 2, 0.5), (3, 4, 5, 0.8), (6, 0, 9, 0.3)], "i bigint, j bigint, k bigint, w double"
    )

    def run(z):
        packs = layout_packs(O.widen(layout_df(spark, z), 2), lists, 2)
        return O.sum_gradients(discrete_gradient_rows(rows, packs, 2, 3, beta=10.0), 2).collect()

    grads = {r.id: (r.g0, r.g1) for r in run(y)}
    h = 1e-6
    for v, c in ((0, 0), (5, 1), (8, 0)):
        ends = []
        for s in (h, -h):
            z = y.copy()
            z[v, c] += s
            ends.append(sum(r.loss for r in run(z)))
        assert grads.get(v, (0.0, 0.0))[c] == pytest.approx((ends[0] - ends[1]) / (2 * h), rel=1e-4, abs=1e-8)


def _step(spark, optimizer, t, **kw):
    state = O.start_state(O.widen(layout_df(spark, [[1.0, 2.0], [3.0, 4.0]]), 2), 2, optimizer)
    state = state.withColumn("t", F.lit(t - 1))
    grads = spark.createDataFrame([(0, 0.5, -0.25, 0.0)], "id bigint, g0 double, g1 double, loss double")
    return {r.id: r for r in O.step(state, grads, 2, optimizer, 0.1, **kw).collect()}


def test_steps_by_hand(spark):
    sgd = _step(spark, "sgd", 1)
    assert (sgd[0].y0, sgd[0].y1) == (0.95, 2.025)
    adam = _step(spark, "sparse_adam", 1)
    assert (adam[0].y0, adam[0].y1) == pytest.approx((0.9, 2.1), abs=1e-5)
    assert (adam[0].m0, adam[0].s0) == pytest.approx((0.05, 0.00025))
    ada = _step(spark, "adagrad", 3, lr_decay=0.5)
    assert ada[0].y0 == pytest.approx(1.0 - 0.05) and ada[0].s1 == 0.0625
    for out in (sgd, adam, ada):
        assert (out[1].y0, out[1].y1) == (3.0, 4.0)
    with pytest.raises(ValueError):
        _step(spark, "lbfgs", 1)


def test_clipping(spark):
    grads = spark.createDataFrame([(0, 3.0, 0.0, 1.0), (1, 0.0, 4.0, 1.0)], "id bigint, g0 double, g1 double, loss double")
    out = O.clipped(grads, 2, 2.5).collect()
    assert sum(r.g0 ** 2 + r.g1 ** 2 for r in out) == pytest.approx(6.25, rel=1e-5)


def test_discrete_radius_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 3))
    js = {i: [int(j) for j in rng.choice([c for c in range(9) if c != i], 3, replace=False)] for i in range(9)}
    lists = spark.createDataFrame(list(js.items()), "i bigint, js array<bigint>")
    triangles = [(0, 1, 2), (3, 4, 5), (8, 2, 6)]
    df = spark.createDataFrame(triangles, "i bigint, j bigint, k bigint")
    got = {(r.i, r.j, r.k): r.r for r in C.discrete_radii(df, C.packs(points_df(spark, x), lists), 10.0).collect()}
    for t in triangles:
        centres = [c for v in t for c in js[v]]
        far = [math.log(sum(math.exp(10 * np.linalg.norm(x[v] - x[c])) for v in t)) / 10 for c in centres]
        assert got[t] == pytest.approx(-math.log(sum(math.exp(-10 * f) for f in far)) / 10)


@pytest.mark.parametrize("single", [True, False])
def test_discrete_radius_moves_the_neighbours_of_one_corner_at_a_time(spark, monkeypatch, single):
    """Uneven lists, repeated triangles, centres in several steps; a triangle never holds two corners' neighbours."""
    monkeypatch.setattr(C, "STEP_ENTRIES", 7)
    held, kept = [], C.add_columns
    monkeypatch.setattr(C, "add_columns", lambda df, *a: held.append(df.columns) or kept(df, *a))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 3)) * [1.0, 1.0, 30.0]
    x = x.astype(np.float32).astype(float) if single else x
    js = {i: [int(j) for j in rng.choice([c for c in range(12) if c != i], i % 5, replace=False)] for i in range(12)}
    lists = spark.createDataFrame(list(js.items()), "i bigint, js array<bigint>")
    triangles = [(1, 0, 2, 0), (0, 5, 4, 1), (0, 5, 4, 2), (5, 10, 3, 0), (8, 2, 6, 3), (9, 7, 11, 0)]
    df = spark.createDataFrame(triangles, "i bigint, j bigint, k bigint, rep int")
    rows = C.discrete_radii(df, C.packs(points_df(spark, x), lists), 10.0)
    got = {(r.i, r.j, r.k, r.rep): r.r for r in rows.collect()}
    assert sorted(got) == sorted(triangles) and set(rows.columns) == {"i", "j", "k", "rep", "r"}
    for t in triangles:
        far = [math.log(sum(math.exp(10 * np.linalg.norm(x[v] - x[c])) for v in t[:3])) / 10 if np.linalg.norm(x[list(t[:3])] - x[c], axis=1).max() < 60
               else np.linalg.norm(x[list(t[:3])] - x[c], axis=1).max() for v in t[:3] for c in js[v]]
        low = min(far)
        assert got[t] == pytest.approx(low - math.log(sum(math.exp(-10 * (f - low)) for f in far)) / 10, abs=1e-9)
    assert all(sum(c.lstrip("_").startswith("n") for c in columns) <= 1 for columns in held)


@pytest.mark.parametrize("phi,soft,d", [("student", True, 2), ("student", False, 3), ("exp", True, 2), ("exp", False, 1)])
def test_sums_by_task_are_the_gradient_rows(spark, phi, soft, d):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(30, d)) * rng.choice([0.01, 1.0, 200.0], size=(30, 1))
    y[1] = y[0]          # a side without length
    y[3] = 2 * y[2] - y[4]
    corners = [(0, 1, 5), (2, 3, 4), *(tuple(int(x) for x in rng.choice(29, 3, replace=False)) for _ in range(200))]
    rows = [(*c, float(w), bool(p)) for c, w, p in zip(corners, rng.uniform(size=202), rng.integers(0, 2, 202))]
    rows.append((29, 0, 5, None, True))  # counts nowhere
    triplets = spark.createDataFrame(rows, "i bigint, j bigint, k bigint, w double, positive boolean").repartition(3)
    wide = spark.createDataFrame([(n, *map(float, x)) for n, x in enumerate(y)], "id bigint, " + ", ".join(f"y{c} double" for c in range(d)))
    losses = O.triangle_losses(O.place(triplets, wide, d, True), phi, 0.7, 1.3, soft, 10.0)
    want = O.gradients(losses, d, 101, 0.5).where("g0 IS NOT NULL").orderBy("id").collect()
    sent = spark.sparkContext.broadcast(O.layout_array(wide.repartition(4), 30, d))
    summed = O.sum_gradients(O.summed_pulls(triplets, sent, d, 101, 0.5, phi, 0.7, 1.3, soft, 10.0), d)
    got = summed.orderBy("id").collect()
    assert [r.id for r in got] == [r.id for r in want] and 29 not in [r.id for r in got]
    assert np.allclose([tuple(r) for r in got], [tuple(r) for r in want], rtol=1e-9, atol=1e-12)


def test_small_packs_go_to_the_tasks_and_triangles_stay(spark, monkeypatch):
    """The same radii and weights as by joins, without a shuffle of triangles; unknown corners go, none has a centre: null."""
    monkeypatch.setattr(C, "STEP_TRIANGLES", 5)
    monkeypatch.setattr(C, "STEP_ENTRIES", 50)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 3)) * [1.0, 1.0, 30.0]
    ids = [10 * i + 3 for i in range(12)]
    js = {10 * i + 3: [int(j) for j in rng.choice([c for c in ids if c != 10 * i + 3], i % 5, replace=False)] for i in range(12)}
    lists = spark.createDataFrame(list(js.items()), "i bigint, js array<bigint>")
    packed = C.packs(points_df(spark, x, ids), lists).localCheckpoint()
    triangles = [(3, 53, 103), (3, 13, 23), (13, 23, 43), (93, 73, 113), (93, 73, 113), (13, 23, 4), (13, 23, None), (43, 33, 3)]
    df = spark.createDataFrame(triangles, "i bigint, j bigint, k bigint")
    radii, weights = [], []
    for limit in (0, C.HELD_BYTES):
        monkeypatch.setattr(C, "HELD_BYTES", limit)
        found = C.discrete_radii(df, packed, 10.0)
        radii.append(sorted((r.i, r.j, r.k, -1.0 if r.r is None else r.r) for r in found.collect()))
        rows = C.weighted_candidates_discrete(packed, 2.0, 10.0)
        weights.append({(r.i, r.j): (r.ks, r.ws) for r in rows.collect()})
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (found, rows)]
        assert ("Exchange" in plans[0]) == (limit == 0) and ("posexplode" in plans[1]) == (limit == 0)
    assert [r[:3] for r in radii[0]] == [r[:3] for r in radii[1]] and len(radii[0]) == 6
    assert [r[3] for r in radii[0]] == pytest.approx([r[3] for r in radii[1]]) and min(r[3] for r in radii[1]) == -1.0
    assert weights[0].keys() == weights[1].keys() and len(weights[1]) == sum(map(len, js.values()))
    for key, (ks, ws) in weights[0].items():
        assert weights[1][key][0] == ks and weights[1][key][1] == pytest.approx(ws)


def test_packs_with_repeated_ids_are_joined(spark):
    x = np.random.default_rng(7).normal(size=(4, 2))
    lists = spark.createDataFrame([(0, [1, 2]), (1, [0]), (2, [3, 3])], "i bigint, js array<bigint>")
    assert C._held(C.packs(points_df(spark, x), lists)) is None
    assert C._held(C.packs(points_df(spark, x, [0, 1, 2, 2]), lists.where("i < 2"))) is None


def test_sums_by_task_are_added_after_their_shuffle(spark):
    """One shuffle and no sum before it, and the same step."""
    state = O.start_state(O.widen(layout_df(spark, np.arange(10.0).reshape(5, 2)), 2), 2, "sparse_adam")
    rows = spark.createDataFrame([(0, 1.0, 2.0, 0.5), (0, 0.5, -2.0, 0.25), (3, 1.0, 1.0, 0.0)], "id bigint, g0 double, g1 double, loss double")
    one, two = (O.step(state, rows, 2, "sparse_adam", by_task=late) for late in (False, True))
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning(id"):]
    assert np.allclose(sorted(map(tuple, one.collect())), sorted(map(tuple, two.collect())), atol=1e-12)


@pytest.mark.parametrize("single", [True, False])
def test_candidates_move_vectors_in_single_precision_if_they_have_no_other(spark, single):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9, 3)).astype(np.float32).astype(float) + (0.0 if single else 1e-12)
    js = {i: [int(j) for j in rng.choice([c for c in range(9) if c != i], 3, replace=False)] for i in range(9)}
    packed = C.packs(points_df(spark, x), spark.createDataFrame(list(js.items()), "i bigint, js array<bigint>"))
    rows = C.weighted_candidates(packed, 2.0, False)
    assert ("as array<float>" in rows._jdf.queryExecution().optimizedPlan().toString()) == single
    for r in rows.collect():
        assert r.ks == [k for k in js[r.i] + js[r.j] if k not in (r.i, r.j)]
        for k, w in zip(r.ks, r.ws):
            sides = [np.linalg.norm(x[p] - x[q]) for p, q in ((r.i, r.j), (r.i, k), (r.j, k))]
            radius = C.ball_radius_rows(*(np.array([s]) for s in sides), False, 10.0)[0]
            assert w == pytest.approx(np.exp(-4.0 * radius / 2.0))
