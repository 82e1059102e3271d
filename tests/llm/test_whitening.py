"""Whitening and its qd solver against plain numpy."""

import math

import numpy as np
import pytest

from ballgraph.llm import whitening
from ballgraph.llm.qd import bidiagonalise, dqds, singular_pairs
from tests.compare import DATA


def _matrices():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    yield from (np.triu(rng.normal(size=(d, d))) for d in (1, 2, 3, 20, 64))
    yield np.zeros((4, 4))
    yield np.diag([3.0, 3, 3, 1, 1, 0])
    yield np.linalg.qr(np.diag(np.r_[np.full(20, 5.0), rng.random(20)]) @ q.T, mode="r")
    yield np.linalg.qr(np.diag(np.r_[5 + 1e-9 * rng.normal(size=20), rng.random(20)]) @ q.T, mode="r")
    yield np.linalg.qr(np.diag(10.0 ** -np.arange(40)) @ q.T, mode="r")
    yield np.linalg.qr(rng.normal(size=(50, 10)) @ rng.normal(size=(10, 30)), mode="r")[:30]


@pytest.mark.parametrize("r", list(_matrices()), ids=str)
def test_singular_pairs(r):
    e, v = singular_pairs(r, len(r))
    want = np.linalg.svd(r, compute_uv=False) ** 2
    k, top = len(e), max(want[0], 1e-300)
    assert np.all(want[k:] <= top * 1e-24)  # only what is zero is left out
    assert np.abs(e - want[:k]).max(initial=0) <= 1e-13 * top
    assert np.abs(r.T @ (r @ v) - v * e).max(initial=0) <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(k)).max(initial=0) <= 1e-12


def test_dqds_keeps_relative_accuracy():
    """Values over 24 orders of magnitude, each to nearly full precision: the determinant is the product."""
    q, e = [10.0 ** -(2 * k) for k in range(13)], [10.0 ** -(2 * k + 3) for k in range(12)]
    found = dqds(q, e)
    assert math.isclose(math.prod(found), math.prod(q), rel_tol=1e-12)
    a, b, _ = bidiagonalise(np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1))
    assert np.allclose(sorted(np.abs(a)), sorted(np.sqrt(q)), rtol=1e-12) and np.allclose(np.abs(b), np.sqrt(e), rtol=1e-12)


def brute(rows, k, scale=256.0):
    """{(id, component): (n, deviation, |whitened|, explained)} by numpy's eigenvectors, for rows that count."""
    whole = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(int(math.floor(scale * c)) for c in v) for _, v in whole]
    lengths = [len(v) for v in set(x)]
    d = max(lengths, key=lambda n: (lengths.count(n), n)) if lengths else 0
    fit = np.array(sorted({v for v in x if len(v) == d}))
    n = len(fit)
    sums = [int(s) for s in fit.sum(axis=0)]
    c = fit - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for (i, _), v in zip(whole, x):
        if len(v) == d:
            dev = sum((n * a - s) ** 2 for a, s in zip(v, sums))
            w = (np.array(v) - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
            out += [(i, j + 1, n, dev, abs(w[j]), values[j] / np.trace(c.T @ c / n)) for j in range(k)]
    return out


def assert_same(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], round(abs(r[4]), 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        assert abs(abs(g[4]) - w[4]) <= 1e-8 and math.isclose(g[5], w[5], rel_tol=1e-9) and g[6] <= 1e-9


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)  # a tree of several levels
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 9)) * np.array([9, 7, 5, 4, 1, 1, 1, 0.5, 0.1]) + 1000
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(900 + i, rows[7][1]) for i in range(300)]  # a vector of many rows counts once in the fit
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (-1, None), (-2, [1.0] * 8 + [None]),
             (-3, [float("nan")] * 9), (-4, [math.inf] + [0.0] * 8), (-5, []), (-6, [1.0] * 4), (-7, [-0.0] * 9)]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id bigint, embedding array<double>, x string, d int")
    got = [tuple(r) for r in whitening.whiten(df.repartition(7)).collect()]
    assert_same(got, brute(rows, 4))
    signs = {}
    for r in got:  # one sign per component for all rows
        if r[0] == 900:
            signs[r[1]] = r[4]
    assert all(math.isclose(r[4], signs[r[1]], rel_tol=1e-9) for r in got if r[0] is not None and 900 <= r[0])


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    got = [tuple(r) for r in whitening.whiten(table).collect()]
    assert_same(got, brute([(r.vec_id, r.embedding) for r in table.collect()], 4))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = whitening.whiten(df)
    assert got.count() == 0 and got.columns[0] == "vec_id"


def test_few_dimensions_and_large_values(spark):
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 1e30]), (3, [0.5, -1e30])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.component for r in got} <= {1, 2} and all(r.n == 3 for r in got)
    assert all((r.deviation is None) == (r.vec_id != 1) for r in got)
