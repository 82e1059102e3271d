"""Neighbour rows to weighted graphs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions.arrow import add_columns
from ballgraph.functions.vectors import list_offsets
from ballgraph.session import Scratch

SIGMA_FLOOR = 1e-3   # fixed value: share of a row's mean distance
TOLERANCE = 1e-13    # of the sum of a row's memberships
MAX_STEPS = 200      # more than halving a bracket of doubles can need


def knn_edges(knn: DataFrame, binarize: bool = True) -> DataFrame:
    """(i, j, w): weight 1, or exp(-d / largest d of the whole table)."""
    if binarize:
        return knn.select("i", "j", F.lit(1.0).alias("w"))
    top = knn.agg(F.max("d")).scalar()
    return knn.select("i", "j", F.exp(-F.col("d") / top).alias("w"))


def in_range(edges: DataFrame, n: int) -> DataFrame:
    """Drops pairs that name an id outside [0, n)."""
    return edges.where(F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1))


def _padded(column) -> np.ndarray:
    """Arrow list column -> matrix, short rows filled with +inf."""
    offsets = list_offsets(column)
    lengths = np.diff(offsets)
    out = np.full((len(lengths), max(int(lengths.max()), 1)), np.inf)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _row_rho(d: np.ndarray, local_connectivity: float, nonzero: bool) -> np.ndarray:
    """The sorted distances, with 0 before the first, read off at a fractional rank."""
    if nonzero or local_connectivity < 1:
        d = np.where(d > 0, d, np.inf)
    line = np.concatenate([np.zeros((len(d), 1)), np.sort(d, axis=1)], axis=1)
    rank = min(local_connectivity, d.shape[1])
    below = line[:, math.floor(rank)]
    with np.errstate(invalid="ignore"):
        rho = below if rank == math.floor(rank) else below + (rank - math.floor(rank)) * (line[:, math.ceil(rank)] - below)
    return np.where(np.isfinite(rho), rho, 0.0)


def _row_sigma(d: np.ndarray, rho: np.ndarray, target: float) -> np.ndarray:
    """The width at which sum(exp(-gap / width)) is the target, by Newton steps kept inside a bracket.

    Of m gaps, z are zero. If all others were the smallest one, the width would be its share of
    log((m - z) / (target - z)); the same with the largest bounds it from above. With z >= target no width is small
    enough, with m <= target none large enough.
    """
    gap = np.where(np.isfinite(d), np.maximum(d - rho[:, None], 0.0), np.inf)
    real = np.isfinite(gap)
    zero, many = (gap == 0).sum(axis=1), real.sum(axis=1)
    mean = np.where(real, d, 0.0).sum(axis=1) / np.maximum(many, 1)
    width = np.where(many <= target, np.inf, 0.0)
    rows = np.flatnonzero((zero < target) & (many > target))
    if len(rows):
        gap, real = gap[rows], real[rows]
        spread = np.log((many[rows] - zero[rows]) / (target - zero[rows]))
        lo = np.where(gap > 0, gap, np.inf).min(axis=1) / spread
        hi = np.where(real, gap, 0.0).max(axis=1) / spread
        at = (lo + hi) / 2.0
        for _ in range(MAX_STEPS):
            part = np.exp(-gap / at[:, None])
            miss = part.sum(axis=1) - target
            lo, hi = np.where(miss < 0, at, lo), np.where(miss < 0, hi, at)
            if (np.abs(miss) <= TOLERANCE * target).all():
                break
            slope = (part * np.where(real, gap, 0.0)).sum(axis=1) / at ** 2
            step = at - miss / np.maximum(slope, np.finfo(np.float64).tiny)
            at = np.where((step > lo) & (step < hi), step, (lo + hi) / 2.0)
        width[rows] = at
    return np.maximum(width, SIGMA_FLOOR * mean)


def smooth_knn(
    lists: DataFrame, k: int, local_connectivity: float = 1.0,
    bandwidth: float = 1.0, nonzero: bool = False,
) -> DataFrame:
    """Adds (sigma, rho) to (i, js, ds): the width at which a row's memberships sum to log2(k).

    rho is the distance of the ``local_connectivity``-th neighbour, zeros included unless
    ``nonzero``. A row with too few neighbours for that sum has an infinite width.
    """
    target = math.log2(max(k, 2)) * bandwidth

    def widths(batch):
        d = _padded(batch.column("ds"))
        rho = _row_rho(d, local_connectivity, nonzero)
        return {"sigma": pa.array(_row_sigma(d, rho, target)), "rho": pa.array(rho)}

    return add_columns(lists, [], widths, {"sigma": "double", "rho": "double"})


def memberships(smoothed: DataFrame) -> DataFrame:
    """(i, j, w) of (i, js, ds, sigma, rho): 1 inside rho or without width, else exponential decay."""
    rows = smoothed.select("i", "sigma", "rho", F.inline(F.arrays_zip("js", "ds")))
    over = F.col("ds") - F.col("rho")
    w = F.when((over <= 0) | (F.col("sigma") <= 0), F.lit(1.0)).otherwise(F.exp(-over / F.col("sigma")))
    return rows.where((F.col("js") >= 0) & (F.col("js") != F.col("i"))).select(
        "i", F.col("js").alias("j"), w.alias("w")
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    """(i, j, a, b) with a = weight of i->j and b = weight of j->i; repeated edges are summed.

    One shuffle, combined inside the tasks first: no self-join of the edge table.
    """
    pair = F.array(
        F.struct(F.col("i"), F.col("j"), F.col("w").alias("a"), F.lit(0.0).alias("b")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("a"), F.col("w").alias("b")),
    )
    return edges.select(F.inline(pair)).groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def fuzzy_union(edges: DataFrame, n: int | None = None, binarize: bool = False) -> DataFrame:
    """Symmetric a + b - a*b of both directions, without the diagonal and without zeros."""
    if n is not None:
        edges = in_range(edges, n)
    a, b = F.col("a"), F.col("b")
    union = _both_ways(edges).select("i", "j", (a + b - a * b).alias("w"))
    union = union.where((F.col("i") != F.col("j")) & (F.col("w") != 0.0))
    if binarize:
        union = union.withColumn("w", (F.col("w") > 0).cast("double"))
    return union


def symmetric_sum(edges: DataFrame) -> DataFrame:
    """W + W^T: a mutual edge of a 0/1 graph gets weight 2."""
    return _both_ways(edges).select("i", "j", (F.col("a") + F.col("b")).alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("w").alias("deg"))


DEGREE_FLOOR = 1e-12


def normalized_adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, j, w) of D^-1/2 (W + W^T) D^-1/2, and (i, r), the roots of the degrees."""
    scratch = Scratch(edges.sparkSession, "adjacency")
    both = scratch.save(symmetric_sum(edges), "both")
    root = scratch.save(
        degrees(both).select("i", F.sqrt(F.greatest("deg", F.lit(DEGREE_FLOOR))).alias("r")), "root"
    )
    other = root.select(F.col("i").alias("j"), F.col("r").alias("rj"))
    scaled = both.join(root, "i").join(other, "j").select(
        "i", "j", (F.col("w") / F.col("r") / F.col("rj")).alias("w")
    )
    return scaled, root
