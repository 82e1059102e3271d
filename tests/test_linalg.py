import numpy as np
import pyarrow as pa
import pytest

from ballgraph.operators import layout as Y
from ballgraph.operators import linalg as A
from tests.helpers import column, layout_df, points_df


def _same_up_to_sign(a, b, tol):
    return all(min(np.abs(a[:, c] - b[:, c]).max(), np.abs(a[:, c] + b[:, c]).max()) < tol
               for c in range(b.shape[1]))


def _numpy_pca(x, d):
    centred = x - x.mean(axis=0)
    _, _, vh = np.linalg.svd(centred, full_matrices=False)
    return centred @ vh[:d].T


def test_pca_matches_svd(spark):
    x = np.random.default_rng(0).normal(size=(120, 6)) * np.array([5, 4, 3, 2, 1, 0.5]) + 3.0
    y = column(A.pca(points_df(spark, x), 3), "v")
    assert _same_up_to_sign(y, _numpy_pca(x, 3), 1e-9)
    assert np.abs(y.mean(axis=0)).max() < 1e-9


def test_more_columns_than_rows(spark):
    x = np.random.default_rng(1).normal(size=(12, 40)) * np.linspace(4, 1, 40)
    assert _same_up_to_sign(column(A.pca(points_df(spark, x), 2), "v"), _numpy_pca(x, 2), 1e-8)


def test_very_wide_branch(spark, monkeypatch):
    monkeypatch.setattr(A, "GRAM_WIDTH_LIMIT", 30)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2)) @ (rng.normal(size=(2, 60)) * 5) + 0.01 * rng.normal(size=(50, 60)) + 7.0
    assert _same_up_to_sign(column(A.pca(points_df(spark, x), 2, 60), "v"), _numpy_pca(x, 2), 1e-4)


def test_truncated_svd(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 3)) * [9, 5, 2]) @ rng.normal(size=(3, 25)) + 0.01 * rng.normal(size=(40, 25))
    x[np.abs(x) < 0.3] = 0.0
    cells = [(i, f"t{j}", float(x[i, j])) for i in range(40) for j in range(25) if x[i, j]]
    rows, singular = A.truncated_svd(spark.createDataFrame(cells, "id bigint, term string, value double"), 3)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(singular, s[:3], rtol=1e-6)
    assert _same_up_to_sign(column(rows, "v"), u[:, :3] * s[:3], 1e-3)


def test_box_layout(spark):
    y = column(Y.box_scale(layout_df(spark, [[0.0, 5], [2, 5], [1, 5]]), 2, 0.0, 0), "y")
    assert y.tolist() == [[0.0, 0.0], [10.0, 0.0], [5.0, 0.0]]


def test_random_layout_ignores_partitions(spark):
    x = np.zeros((200, 1))
    one = column(Y.random_layout(points_df(spark, x, parts=1), 2, 7), "y")
    seven = column(Y.random_layout(points_df(spark, x, parts=7), 2, 7), "y")
    assert (one == seven).all()
    assert one.min() >= -10 and one.max() < 10 and abs(one.mean()) < 1.0
    assert (one != column(Y.random_layout(points_df(spark, x), 2, 8), "y")).any()


def test_svd_by_joins_and_empty_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_BYTES", 1)
    x = np.array([[3.0, 0, 0, 1], [0, 2, 0, 0], [1, 0, 1, 0], [0, 0, 0, 0], [2, 1, 0, 3]])
    cells = [(i, f"t{j}", float(x[i, j])) for i in range(5) for j in range(4) if x[i, j]]
    ids = spark.range(5)
    terms = spark.createDataFrame(cells, "id bigint, term string, value double")
    rows, singular = A.truncated_svd(terms, 2, ids=ids)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(singular, s[:2])
    assert _same_up_to_sign(column(rows, "v"), u[:, :2] * s[:2], 1e-6)


def test_block_iteration_converges_where_values_are_close():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    values = np.concatenate([[1.0, 0.97, 0.95, 0.94], np.linspace(0.93, 0.0, 296)])
    m = (q * values) @ q.T
    images = []
    image = lambda x: images.append(x.shape) or m @ x
    top, found = A.leading_pairs(A.ArrayBlocks(), rng.normal(size=(300, 10)), image, 10, 4, 1e-6, 200)
    assert np.allclose(found, values[:4], atol=1e-9) and _same_up_to_sign(top, q[:, :4], 1e-3)
    assert len(images) < 60 and set(images) == {(300, 10)}
    with pytest.warns(UserWarning, match="residual"):
        A.leading_pairs(A.ArrayBlocks(), rng.normal(size=(300, 10)), image, 10, 4, 1e-6, 2)


def test_svd_both_ways_of_multiplying_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.poisson(0.6, size=(90, 60)) * np.linspace(2, 1, 60)
    cells = [(i, f"t{j}", float(x[i, j])) for i in range(90) for j in range(60) if x[i, j]]
    terms = spark.createDataFrame(cells, "id bigint, term string, value double").repartition(4)
    sent, s_sent = A.truncated_svd(terms, 3, oversample=3)
    sent = column(sent, "v")
    monkeypatch.setattr(A, "BROADCAST_BYTES", 1)
    joined, s_joined = A.truncated_svd(terms, 3, oversample=3)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s_sent, s[:3], rtol=1e-9) and np.allclose(s_joined, s[:3], rtol=1e-9)
    assert np.allclose(column(joined, "v"), sent, atol=1e-4)  # the same signs, too
    assert _same_up_to_sign(sent, u[:, :3] * s[:3], 1e-3)


def test_packed_rows_are_multiplied_in_bounded_steps(monkeypatch):
    from ballgraph.operators import linalg

    monkeypatch.setattr(linalg, "STEP_ENTRIES", 24)
    sizes = [1, 5, 9, 2, 2, 2, 3]
    batch = pa.RecordBatch.from_pydict({
        "codes": pa.array([list(range(n)) for n in sizes]), "values": pa.array([[1.0] * n for n in sizes]),
    })
    steps = [part["codes"].to_pylist() for part in linalg._steps(batch, 4)]
    assert [row for part in steps for row in part] == batch["codes"].to_pylist()
    assert all(len(part) == 1 or sum(map(len, part)) <= 6 for part in steps) and len(steps) == 4
