import numpy as np
import pyarrow as pa
import pytest

from ballgraph.operators import ivf as I
from ballgraph.operators import knn as K
from ballgraph.operators import lsh as L
from ballgraph.operators import probe as P
from ballgraph.operators.neighbours import knn
from tests.helpers import assert_same_knn, blobs, brute_knn, knn_dict, points_df


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ROWS", 40)
    monkeypatch.setattr(P, "QUERY_ROWS", 16)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_chunked_matches_brute_force(spark, small_chunks, metric):
    x, _ = blobs(80, 4, 6, seed=1)
    got = knn_dict(K.exact_knn(points_df(spark, x), 7, metric))
    assert_same_knn(got, brute_knn(x, 7, metric))


def test_far_from_the_origin(spark, small_chunks):
    rng = np.random.default_rng(5)
    x = 1e6 + rng.normal(size=(150, 5))
    assert_same_knn(knn_dict(K.exact_knn(points_df(spark, x), 5)), brute_knn(x, 5), tol=1e-6)


def test_a_third_of_the_rows_are_copies(spark, small_chunks):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 4))
    x[::3] = x[0]
    x[1::50] = x[1]
    assert_same_knn(knn_dict(K.exact_knn(points_df(spark, x), 6)), brute_knn(x, 6))


def test_zero_rows_have_cosine_distance_one(spark, small_chunks):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(130, 4))
    x[10] = 0.0
    x[90] = 0.0
    got, want = knn_dict(K.exact_knn(points_df(spark, x), 4, "cosine")), brute_knn(x, 4, "cosine")
    for key, (_, d) in want.items():
        assert abs(got[key][1] - d) < 1e-9


def test_fewer_points_than_neighbours(spark):
    got = knn_dict(K.exact_knn(points_df(spark, [[0.0, 0], [1, 0], [5, 0]]), 5))
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 5.0), (1, 1): (0, 1.0), (1, 2): (2, 4.0),
                   (2, 1): (1, 4.0), (2, 2): (0, 5.0)}


def test_partitioning_does_not_matter(spark, small_chunks):
    x, _ = blobs(40, 3, 5, seed=4)
    one = knn_dict(K.exact_knn(points_df(spark, x, parts=1), 5))
    assert one == knn_dict(K.exact_knn(points_df(spark, x, parts=7), 5))


def test_bad_arguments(spark):
    points = points_df(spark, [[0.0, 1], [1, 0]])
    with pytest.raises(ValueError, match="positive"):
        K.exact_knn(points, 0)
    with pytest.raises(ValueError, match="metric"):
        K.exact_knn(points, 1, "manhattan")
    with pytest.raises(ValueError, match="method"):
        knn(points, 1, "hnsw")


def test_all_lists_probed_is_exact(spark, small_chunks):
    x, _ = blobs(50, 3, 6, seed=6)
    got = knn_dict(knn(points_df(spark, x), 5, "ivf", n_lists=12, n_probe=12))
    assert_same_knn(got, brute_knn(x, 5))


def _recall(got, want):
    pairs = {(i, j) for (i, _), (j, _) in got.items()}
    return np.mean([(i, j) in pairs for (i, _), (j, _) in want.items()])


@pytest.mark.parametrize("method, options, floor", [
    ("ivf", {"n_lists": 12, "n_probe": 4}, 0.9),
    ("ivfpq", {"n_lists": 6, "n_probe": 6, "refine": 4}, 0.8),
    ("lsh", {"hashes": 2}, 0.9),
    ("nndescent", {"init": "random"}, 0.9),
    ("nndescent", {}, 0.9),
])
def test_approximate_recall(spark, small_chunks, method, options, floor):
    x, _ = blobs(70, 3, 8, seed=7)
    want = brute_knn(x, 8)
    got = knn_dict(knn(points_df(spark, x), 8, method, **options))
    assert _recall(got, want) >= floor
    for (i, _), (j, d) in got.items():
        assert i != j
    if method != "ivfpq":
        for (i, _), (j, d) in list(got.items())[:50]:
            assert abs(np.linalg.norm(x[i] - x[j]) - d) < 1e-9


def test_nndescent_with_sparse_ids_and_copies(spark, small_chunks):
    x, _ = blobs(40, 3, 5, seed=8)
    x[::3] = x[0]
    ids = [i * 10 + 3 for i in range(len(x))]
    got = knn_dict(knn(points_df(spark, x, ids), 5, "nndescent", init="random"))
    assert len(got) == len(x) * 5
    assert all(i % 10 == 3 and j % 10 == 3 for (i, _), (j, _) in got.items())
    zero = [key for key in got if key[0] == ids[0]]
    assert all(got[key][1] == 0.0 for key in zero)


def test_search_plans_have_no_cross_product(spark):
    x, _ = blobs(30, 3, 5)
    for method in ("exact", "ivf", "lsh"):
        plan = knn(points_df(spark, x), 3, method)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_recall_of_itself(spark):
    near = K.exact_knn(points_df(spark, blobs(20)[0]), 3)
    assert K.recall(near, near).first().recall == 1.0


def test_popular_chunks_are_split(spark, small_chunks, monkeypatch):
    monkeypatch.setattr(P, "SPLIT_QUERIES", 30)
    monkeypatch.setattr(P, "ESTIMATE_ROWS", 200)
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(300, 6)), 0.01 * rng.normal(size=(150, 6))])
    assert_same_knn(knn_dict(K.exact_knn(points_df(spark, x), 6)), brute_knn(x, 6))
    got = knn_dict(knn(points_df(spark, x), 6, "ivf", n_lists=5, n_probe=5))
    assert_same_knn(got, brute_knn(x, 6))
    lsh = knn_dict(knn(points_df(spark, x), 6, "lsh", hashes=1, tables=2, width=1e6))
    assert_same_knn(lsh, brute_knn(x, 6))


def test_planned_queries_leave_in_bounded_batches(monkeypatch):
    """However many chunks a query is sent to, a batch holds so many vector entries at most."""
    monkeypatch.setattr(P, "SEND_ENTRIES", 40)
    batch = pa.RecordBatch.from_pydict({
        "id": pa.array([7, 8, 9]), "v": pa.array([[float(i)] * 4 for i in range(3)]), "aux": pa.array([[1.0], [2.0], [3.0]]),
    })
    rows, chunks = np.repeat(np.arange(3), 50), np.tile(np.arange(50), 3)
    sent = list(P._send(batch, rows, chunks, 4))
    assert max(b.num_rows for b in sent) == 10
    table = pa.Table.from_batches(sent)
    assert table["id"].to_pylist() == [7] * 50 + [8] * 50 + [9] * 50
    assert table["chunk"].to_pylist() == chunks.tolist()
    assert table["v"].to_pylist()[-1] == [2.0] * 4


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("kind", ["plain", "far member", "far query", "far cloud", "copies", "grid", "tiny"])
def test_kernels_agree_with_plain_distances(metric, kind):
    """The bounds of the matrix product lose no member, also where single precision is too coarse or too short."""
    rng = np.random.default_rng(0)
    m, q = rng.normal(size=(90, 5)), rng.normal(size=(20, 5))
    m[3], q[4] = (1e6 if kind == "far member" else m[3]), (1e15 if kind == "far query" else q[4])
    m, q = (m + 1e6, q + 1e6) if kind == "far cloud" else (m, q)
    m, q = (m[np.arange(90) % 7], m[np.arange(20) % 7]) if kind == "copies" else (m, q)
    m, q = (np.round(m), np.round(q)) if kind == "grid" else (m, q)
    m, q = (m * 1e-30, q * 1e-30) if kind == "tiny" else (m, q)
    if metric == "cosine":
        m, q = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), K.COSINE_EPS) for x in (m, q))
    mid = rng.permutation(200)[:90]
    qid = np.concatenate([mid[:10], np.arange(300, 310)])
    d = np.array([P.pair_distance(np.repeat(a[None], 90, axis=0), m, metric) for a in q])
    for reach in (np.inf, 1.5):
        got = P.nearest_work(9, metric)(mid, m)(qid, q, np.full((20, 1), reach))
        want = [
            (qid[a], mid[c], d[a, c]) for a in range(20)
            for c in [c for c in np.lexsort((mid, d[a])) if d[a, c] <= reach * (1.0 + 1e-9) + 1e-9][:9]
        ]
        assert list(zip(*(got[c].to_pylist() for c in "qmd"))) == want
    level = d[:, [5, 40, 80]]
    got = np.array(P.closer_work(metric)(mid, m)(qid, q, level)["n"]).reshape(20, 3)
    assert (got == ((d[:, None] < level[:, :, None]) & (mid != qid[:, None])[:, None]).sum(axis=2)).all()


def test_all_candidates_refined_are_measured_in_their_chunk(spark, monkeypatch):
    """With as many candidates as rows, no pair of points is written: each chunk returns k + 1 a query at most."""
    monkeypatch.setattr(P, "CHUNK_ROWS", 60)
    x = np.random.default_rng(6).normal(size=(200, 5))
    rows = []
    kept = I.top_rows
    monkeypatch.setattr(I, "top_rows", lambda df, *a: rows.append(df.count()) or kept(df, *a))
    got = knn_dict(knn(points_df(spark, x), 4, "ivfpq", n_lists=4, n_probe=4, refine=200))
    assert_same_knn(got, brute_knn(x, 4))
    assert max(rows) <= 200 * 5 * 12


def test_equal_buckets_are_searched_once(spark, monkeypatch):
    x, _ = blobs(30, 2, 4, seed=3)
    rows = []
    kept = L.P.probe
    monkeypatch.setattr(L.P, "probe", lambda members, *a: rows.append(members.count()) or kept(members, *a))
    got = knn_dict(knn(points_df(spark, x), 5, "lsh", tables=6, hashes=1, width=1e6))
    assert_same_knn(got, brute_knn(x, 5))
    assert rows == [60]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_plans_leave_out_no_chunk_with_an_answer(spark, metric):
    """Also with empty cells, equal pivots, several chunks a cell and all-zero vectors."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    x[5] = 0.0
    if metric == "cosine":
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), K.COSINE_EPS)
    pivots = np.concatenate([x[:9], x[:2], [[50.0, 0, 0]]])
    near = P._pivot_distances(x, pivots).argmin(axis=1)
    chunk = 2 * near + np.arange(300) % 2
    dp = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))
    of = [dp[chunk == c] for c in range(24)]
    cells = P.Cells(
        pivots, np.repeat(np.arange(12), 2), np.array([d.min(initial=np.inf) for d in of]),
        np.array([d.max(initial=-np.inf) for d in of]), np.array([(~x[chunk == c].any(axis=1)).any() for c in range(24)]),
    )
    reach = rng.uniform(0.05, 0.4, size=300)
    reach[:5] = np.inf
    rows = [(i, [float(c) for c in x[i]], [float(reach[i])], int(chunk[i])) for i in range(300)]
    queries = spark.createDataFrame(rows, "id bigint, v array<double>, aux array<double>, own bigint")
    sent = {(r.id, r.chunk) for r in P.plan_by_bounds(queries, cells, metric, True).select("id", "chunk").collect()}
    assert all(c != chunk[i] for i, c in sent) and {c for i, c in sent if i == 0} == set(chunk) - {chunk[0]}
    for i in range(300):
        d = P.pair_distance(np.repeat(x[i:i + 1], 300, axis=0), x, metric)
        assert {(i, c) for c in chunk[d <= reach[i]] if c != chunk[i]} <= sent
    assert len(sent) < 300 * 20


def test_equal_vectors_are_grouped_once(spark, monkeypatch):
    """The three tables of equal vectors come from one written table, sorted by a hash before the vectors."""
    keys, kept = [], K.top_rows
    monkeypatch.setattr(K, "top_rows", lambda df, key, *a: keys.append(key) or kept(df, key, *a))
    x = np.random.default_rng(9).normal(size=(60, 3))
    x[20:40] = x[0]
    points = points_df(spark, x)
    scratch = K.Scratch(spark, "test")
    tables = K._copies(points, 4, scratch)
    assert keys == [["h", "v"]] and all("distinct" in str(t.inputFiles()) for t in tables)
    assert sorted(r.j for r in tables[1].where("u = 0").collect()) == [0, 20, 21, 22]
    assert {(r.i, r.u) for r in tables[2].collect()} == {(i, 0 if 20 <= i < 40 else i) for i in range(60)}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("far", [0.0, 1e5])
def test_ranks_of_many_thresholds_come_from_a_histogram(monkeypatch, metric, far):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(700, 6)).round(1)
    m[100:140], m[8] = m[7], 3 * m[8]
    m[5] += far
    q = np.vstack([m[:20], rng.normal(size=(10, 6)), m[:3] + 1e4])
    if metric == "cosine":
        m, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in (m, q))
    mid = rng.permutation(700)
    qid = np.concatenate([mid[:20], 1000 + np.arange(13)])
    to = rng.integers(0, 700, (33, 14))
    to[:, 0], to[:, 1] = 100, 5
    aux = np.stack([P.pair_distance(q, m[to[:, s]], metric) for s in range(14)], axis=1)
    aux[:, 3] = 0.0
    d = np.stack([P.pair_distance(np.repeat(x[None], 700, 0), m, metric) for x in q])
    d[mid == qid[:, None]] = np.inf
    want = (d[:, None, :] < aux[:, :, None]).sum(axis=2)
    binned, calls = P._binned_counts, []
    monkeypatch.setattr(P, "BIN_WORK", 1000)
    monkeypatch.setattr(P, "_binned_counts", lambda *a: calls.append(1) or binned(*a))
    got = np.array(P.closer_work(metric)(mid, m)(qid, q, aux)["n"]).reshape(33, 14)
    assert (got == want).all()
    assert bool(calls) == (metric == "cosine" or not far)  # a far member would widen all ranges


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_lists_of_copies_are_not_dealt_out_by_point(spark, small_chunks, monkeypatch, limit):
    """Neighbour lists move once per vector; points only meet them, and vectors move once to be grouped."""
    monkeypatch.setattr(K, "COPY_BYTES", limit)
    x = np.random.default_rng(10).normal(size=(260, 3)).round(1)
    x[100:140], x[200] = x[3], -0.0 * x[200]
    x[201] = 0.0
    near = K.exact_knn(points_df(spark, x), 6)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i#" not in plan
    assert_same_knn(knn_dict(near), brute_knn(x, 6))


def test_hashes_that_name_their_vectors_move_alone(spark):
    x = np.random.default_rng(11).normal(size=(60, 3))
    x[20:40], x[50] = x[0], x[45]
    points, owners = points_df(spark, x), {}
    for known in (None, 39, 40):  # 39 vectors: with another number of hashes, vectors are compared
        owner = K._copies(points, 4, K.Scratch(spark, "test"), known)[2]
        owners[known] = {(r.i, r.u) for r in owner.collect()}
        join = next(x for x in owner._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
        assert ("v#" in join) == (known != 39)
    want = {(i, 0 if 20 <= i < 40 else 45 if i == 50 else i) for i in range(60)}
    assert all(found == want for found in owners.values())


def test_members_of_whole_chunks_travel_once(spark, small_chunks, monkeypatch):
    monkeypatch.setattr(P, "own_parts", lambda *a: 1)
    x = np.random.default_rng(12).normal(size=(300, 3))
    members, cells = P.chunked(points_df(spark, x), 300, 3, 0, K.Scratch(spark, "test"))
    own = P.probe_own(members, 300, len(cells), P.nearest_work(3, "euclidean"))
    assert "Union" not in own._jdf.queryExecution().optimizedPlan().toString()
    chunk = {r.id: r.chunk for r in members.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(i, j) for i in range(300) for j in sorted((j for j in range(300) if chunk[j] == chunk[i]), key=lambda j: (d[i, j], j))[:3]}
    assert {(r.q, r.m) for r in own.collect()} == want
