"""Small fixtures and plain numpy answers to compare with."""

from __future__ import annotations

import numpy as np


def points_df(spark, x, ids=None, parts=3):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, "id bigint, v array<double>").repartition(parts)


def layout_df(spark, y):
    return points_df(spark, y).withColumnRenamed("v", "y")


def blobs(n_each=50, centres=3, width=10, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width)) * 4.0
    x = np.concatenate([m + spread * rng.normal(size=(n_each, width)) for m in c])
    return x, np.repeat(np.arange(centres), n_each)


def brute_knn(x, k, metric="euclidean"):
    """{(i, rank): (j, d)} by (d, j)."""
    if metric == "cosine":
        norms = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(np.float32).eps)
        u = x / norms
        d = np.array([[1.0 - (a * b).sum() for b in u] for a in u])
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = {}
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:k]
        for r, j in enumerate(order, 1):
            out[(i, r)] = (int(j), float(d[i, j]))
    return out


def knn_dict(df):
    return {(r.i, r.rank): (r.j, r.d) for r in df.collect()}


def assert_same_knn(got, want, tol=1e-9):
    assert got.keys() == want.keys()
    for key, (j, d) in want.items():
        assert abs(got[key][1] - d) <= tol, (key, got[key], (j, d))
        assert got[key][0] == j, (key, got[key], (j, d))


def column(df, name, key="id"):
    return np.array([r[1] for r in sorted((row[key], row[name]) for row in df.collect())])
