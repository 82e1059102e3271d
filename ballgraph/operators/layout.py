"""Initial layouts ``(id, y ARRAY<DOUBLE>)``."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions import draws
from ballgraph.functions.draws import number
from ballgraph.operators import graph as G
from ballgraph.operators.linalg import (
    BROADCAST_BYTES, block_gram, gram, leading_signs, orthonormalise, pca, rotate,
)
from ballgraph.session import Scratch

# Fixed values of the layouts.
BOX = 10.0           # side of the start box, and half the side of the random one
JITTER = 1e-4
EMPTY_SPREAD = 1e-3
SPAN_FLOOR = 1e-8
STD_FLOOR = 1e-6
TOLERANCE = 1e-5     # of the eigenvectors' residual
MAX_ROUNDS = 30


def box_scale(layout: DataFrame, n_components: int, jitter: float, seed: int,
              hasher: str = "xxhash64") -> DataFrame:
    """Each coordinate min-max scaled to [0, 10], plus a small normal jitter."""
    ends = layout.agg(F.struct(*[
        f(F.get("y", F.lit(c))).alias(f"{side}{c}")
        for c in range(n_components) for side, f in (("lo", F.min), ("hi", F.max))
    ]).alias("e")).scalar()
    cols = []
    for c in range(n_components):
        lo, hi = F.col(f"_e.lo{c}"), F.col(f"_e.hi{c}")
        x = F.lit(BOX) * (F.get("y", F.lit(c)) - lo) / F.greatest(hi - lo, F.lit(SPAN_FLOOR))
        if jitter:
            x = x + F.expr(draws.gauss((seed, "jitter", c), "id", hasher=hasher)) * jitter
        cols.append(x)
    return layout.withColumn("_e", ends).select("id", F.array(*cols).alias("y"))


def pca_layout(points: DataFrame, n_components: int, seed: int, width: int | None = None) -> DataFrame:
    flat = pca(points.select("id", "v"), n_components, width).withColumnRenamed("v", "y")
    return box_scale(flat, n_components, JITTER, seed)


def random_layout(points: DataFrame, n_components: int, seed: int, hasher: str = "xxhash64") -> DataFrame:
    """Uniform in [-10, 10)."""
    span = [
        F.expr(draws.uniform((seed, "init", c), "id", hasher=hasher)) * (2.0 * BOX) - BOX
        for c in range(n_components)
    ]
    return points.select("id", F.array(*span).alias("y"))


def tiny_layout(points: DataFrame, n_components: int, seed: int) -> DataFrame:
    """Normal draws of size 1e-3, for a graph without edges."""
    span = [F.expr(draws.gauss((seed, "empty", c), "id")) * EMPTY_SPREAD for c in range(n_components)]
    return points.select("id", F.array(*span).alias("y"))


def _names(prefix: str, width: int) -> list[str]:
    return [f"{prefix}{c}" for c in range(width)]


def _wide(block: DataFrame, width: int) -> DataFrame:
    """(id, q ARRAY) -> (id, q0, q1, ...), whose sums are generated code."""
    return block.selectExpr("id", *[f"q[{c}] AS q{c}" for c in range(width)])


def _spread(edges: DataFrame, block: DataFrame, columns: list[str], small: bool) -> DataFrame:
    """Edges (i, j, w) joined with the columns of a block at j."""
    source = block.selectExpr("id AS j", *columns)
    return edges.join(F.broadcast(source) if small else source, "j")


def _filtered(edges: DataFrame, block: DataFrame, width: int, cut: float, degree: int,
              small: bool, scratch: Scratch, tag: str) -> DataFrame:
    """Chebyshev polynomial of the adjacency that damps its spectrum on [-1, cut].

    A step needs A q, q and the q before (p). All of it is one join of the edges with the block and one
    grouped sum: edges contribute A q, and each row itself contributes the rest.
    """
    centre, half = (cut - 1.0) / 2.0, (cut + 1.0) / 2.0
    ps, qs = _names("p", width), _names("q", width)
    state = block.selectExpr("id", *[f"0D AS {p}" for p in ps], *qs)
    for step in range(degree):
        gain = (1.0 if step == 0 else 2.0) / half
        far = _spread(edges, state, qs, small).selectExpr(
            "i AS id", *[f"0D AS {p}" for p in ps], *[f"{q} * w * {number(gain)} AS {q}" for q in qs]
        )
        own = state.selectExpr(
            "id", *[f"{q} AS {p}" for p, q in zip(ps, qs)],
            *[f"-{q} * {number(gain * centre)} - {p} AS {q}" for p, q in zip(ps, qs)],
        )
        total = far.unionByName(own).groupBy("id").agg(*[F.sum(c).alias(c) for c in ps + qs])
        state = scratch.save(total, f"{tag}-{step}")
        if step:
            scratch.drop(f"{tag}-{step - 1}")
    return state.selectExpr("id", f"array({', '.join(qs)}) AS q")


def leading_eigenvectors(
    adjacency: DataFrame, degree_root: DataFrame, n: int, n_vectors: int, rounds: int = MAX_ROUNDS,
    degree: int = 10, oversample: int = 6, seed: int = 0, tolerance: float = TOLERANCE,
) -> tuple[DataFrame, np.ndarray]:
    """Largest eigenpairs of a normalised adjacency (i, j, w) by Chebyshev-filtered subspace iteration.

    The known top vector, the root of the degrees, is the first column of the start block. Rounds end when no wanted
    pair's residual, the length of A q - value q, is above ``tolerance``; a warning tells if that took too many.
    """
    scratch = Scratch(adjacency.sparkSession, "spectral")
    edges = scratch.save(adjacency.select("i", "j", "w"), "edges")
    width = min(n_vectors + oversample, n)
    qs = _names("q", width)
    rest = [draws.gauss((seed, "block", c), "i") for c in range(1, width)]
    block = scratch.save(
        degree_root.selectExpr("i AS id", f"array({', '.join(['r', *rest])}) AS q"), "start"
    )
    block = orthonormalise(block, "id", width)
    small = n * (2 * width * 8 + 32) <= BROADCAST_BYTES
    cut, values = 0.5, None
    for r in range(rounds):
        filtered = _filtered(edges, _wide(block, width), width, cut, degree, small, scratch, f"round{r}")
        block = scratch.save(orthonormalise(filtered, "id", width), f"basis{r}")
        image = _spread(edges, _wide(block, width), qs, small).groupBy(F.col("i").alias("id")).agg(
            *[F.expr(f"sum({q} * w) AS {q}") for q in qs]
        ).selectExpr("id", f"array({', '.join(qs)}) AS p")
        both = block.join(image, "id").select("id", F.concat("q", "p").alias("q"))
        products = block_gram(both, 2 * width)
        small_problem = products[:width, width:]
        values, vectors = np.linalg.eigh((small_problem + small_problem.T) / 2.0)
        values, vectors = values[::-1], vectors[:, ::-1]
        block = rotate(block, "id", vectors)
        # of q = Q s: |A q|^2 - 2 value q.Aq + value^2
        image_sq = np.einsum("ac,ab,bc->c", vectors, products[width:, width:], vectors)
        along = np.einsum("ac,ab,bc->c", vectors, small_problem, vectors)
        residual = np.sqrt(np.maximum(image_sq - 2.0 * values * along + values ** 2, 0.0))[:n_vectors].max()
        if residual <= tolerance:
            break
        cut = float(np.clip(values[-1], -0.9, 0.999))
    if residual > tolerance:
        warnings.warn(f"the spectral layout stopped after {rounds} rounds with a residual of {residual:.1e}", stacklevel=2)
    picked = block.select("id", F.slice("q", 1, n_vectors).alias("q"))
    return picked, values[:n_vectors]


def spectral_layout(
    points: DataFrame, edges: DataFrame, n: int, n_components: int, seed: int = 0, **options
) -> DataFrame:
    """Eigenvectors 2..d+1 of the normalised adjacency, centred, unit sample std, times 10."""
    if edges.isEmpty():
        return tiny_layout(points, n_components, seed)
    adjacency, root = G.normalized_adjacency(edges)
    vectors, _ = leading_eigenvectors(adjacency, root, n, n_components + 1, seed=seed, **options)
    rest = vectors.select("id", F.slice("q", 2, n_components).alias("q"))
    # a point without an edge has a zero row in the adjacency, so its entries are zero
    none = F.array(*[F.lit(0.0)] * n_components)
    rest = Scratch(points.sparkSession, "spectral-rows").save(
        points.select("id").join(rest, "id", "left").select("id", F.coalesce("q", none).alias("q")), "rest"
    )
    count, mean, cov = gram(rest.select(F.col("q").alias("v")), n_components)
    signs = leading_signs(rest, "id", n_components)
    scale = BOX * signs / np.maximum(np.sqrt(np.diag(cov)), STD_FLOOR)
    cols = [
        (F.get("q", F.lit(c)) - F.lit(float(mean[c]))) * F.lit(float(scale[c]))
        for c in range(n_components)
    ]
    return rest.select("id", F.array(*cols).alias("y"))
