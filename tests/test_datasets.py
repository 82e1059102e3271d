import numpy as np
import pytest

from ballgraph.operators import counts as C
from ballgraph.plans import datasets as D
from tests.helpers import blobs, column, points_df


def test_text_points(spark):
    docs = [(0, "red fox runs"), (1, "red fox sleeps"), (2, "blue whale swims"), (3, "blue whale dives"), (4, "of the")]
    df = spark.createDataFrame(docs, "id bigint, text string")
    v = column(D.text_points(df, n_components=2, min_df=1), "v")
    lengths = np.linalg.norm(v, axis=1)
    assert np.allclose(lengths[:4], 1.0) and lengths[4] == 0.0
    assert v[0] @ v[1] > 0.9 > 0.1 > abs(v[0] @ v[2])


def test_dense_rows(spark):
    cells = spark.createDataFrame([(0, "a", 1.0), (0, "c", 2.0), (1, "z", 9.0)], "id bigint, feature string, value double")
    ids = spark.createDataFrame([(0,), (1,), (2,)], "id bigint")
    assert column(C.dense_rows(cells, ["a", "b", "c"], ids), "v").tolist() == [[1, 0, 2], [0, 0, 0], [0, 0, 0]]
    assert column(C.dense_rows(cells, ["a", "b", "c"]), "v").tolist() == [[1, 0, 2]]


@pytest.mark.parametrize("do_scale", [False, True])
def test_count_points(spark, do_scale):
    rng = np.random.default_rng(0)
    counts = rng.poisson(np.r_[np.full((20, 8), 3.0), np.tile([9.0, 9, 9, 9, 1, 1, 1, 1], (20, 1))])
    rows = [(i, f"g{j}", float(counts[i, j])) for i in range(40) for j in range(8) if counts[i, j]]
    cells = spark.createDataFrame(rows, "id bigint, feature string, value double")
    v = column(D.count_points(cells, n_top=6, n_components=3, do_scale=do_scale), "v")
    assert v.shape == (40, 3) and np.abs(v.mean(axis=0)).max() < 1e-9


def test_cluster_labels(spark):
    x, want = blobs(25, 3, 5, seed=2)
    labels = column(D.cluster_labels(points_df(spark, x), 6), "label")
    assert sorted(set(labels)) == list(range(labels.max() + 1))
    assert all(len(set(want[labels == c])) == 1 for c in set(labels))


def test_table_points(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "b", 3.0), (2, None, 5.0)], "id bigint, c string, x double")
    raw = column(D.table_points(df, "id", ["c"], ["x"], standardize=False), "v")
    assert raw.tolist() == [[1, 1, 0], [3, 0, 1], [5, 0, 0]]
    v = column(D.table_points(df, "id", ["c"], ["x"]), "v")
    assert np.allclose(v.mean(axis=0), 0) and np.allclose(v.std(axis=0), 1)
