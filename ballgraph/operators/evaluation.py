"""Scores of a layout against the points it came from."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions import draws
from ballgraph.functions.arrow import add_columns
from ballgraph.functions.vectors import list_matrix
from ballgraph.operators import probe as P
from ballgraph.operators.knn import exact_knn, prepared, top_rows
from ballgraph.operators.linalg import gram, pca
from ballgraph.session import Scratch
from ballgraph.sources.points import validate_points

SAMPLE_MARGIN = 6   # square roots of the size that a sample's bound allows for chance


def as_points(layout: DataFrame) -> DataFrame:
    return layout.select("id", F.col("y").alias("v"))


def intruder_ranks(points: DataFrame, near: DataFrame, metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """(i, j, rank): for neighbours (i, j, rank) of a layout, the rank of j around i in the points.

    The rank is one plus the number of points strictly closer to i than j is. It is counted against
    the chunks of points that can hold closer ones; nothing is sorted and no pair is written out.
    """
    scratch = Scratch(points.sparkSession, "ranks")
    shape = validate_points(points)
    n = shape["n"]
    vectors = prepared(points, metric)
    left = vectors.select(F.col("id").alias("i"), F.col("v").alias("vi"))
    right = vectors.select(F.col("id").alias("j"), F.col("v").alias("vj"))
    pairs = near.select("i", "j", F.col("rank").alias("slot")).join(right, "j").join(left, "i")

    def measure(batch):
        vi, vj = list_matrix(batch.column("vi")), list_matrix(batch.column("vj"))
        return {"d": pa.array(P.pair_distance(vi, vj, metric))}

    measured = scratch.save(add_columns(pairs, ["vi", "vj"], measure, {"d": "double"}), "pairs")
    sought = measured.groupBy("i").agg(
        F.array_sort(F.collect_list(F.struct("slot", "j", "d"))).alias("l")
    ).select(F.col("i").alias("id"), F.col("l.j").alias("js"), F.col("l.d").alias("aux"))
    sought = scratch.save(sought, "sought")
    most = sought.agg(F.max(F.size("aux"))).first()[0] or 0
    # the thresholds of a task are a matrix; nothing is closer than 0
    sought = sought.withColumn("aux", F.concat("aux", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("aux"))))
    members, cells = P.chunked(vectors, n, shape["max_width"], seed, scratch)
    queries = members.select("id", "v", "chunk").join(sought.select("id", "aux"), "id")
    work, schema = P.closer_work(metric), P.CLOSER_SCHEMA
    if cells is None:
        parts = P.own_parts(points.sparkSession, n, 1)
        counted = P.probe(P.with_parts(members, parts), P.with_parts(queries, parts), n, work, schema)
    else:
        plan = lambda rows: P.plan_by_bounds(rows, cells, metric, skip_own=False)
        queries = scratch.save(queries, "queries")
        counted = P.probe_planned(members, queries, n, len(cells), plan, work, schema)
    total = counted.groupBy("q", "slot").agg((F.sum("n") + 1).alias("rank"))
    names = sought.select("id", F.posexplode("js").alias("slot", "j"))
    return names.join(total, (names.id == total.q) & (names.slot == total.slot)).select(
        F.col("id").alias("i"), "j", "rank"
    )


def trustworthiness(points: DataFrame, layout: DataFrame, k: int = 15, metric: str = "euclidean") -> DataFrame:
    """One row: 1 minus the scaled sum of how far layout neighbours rank beyond k among the points."""
    n = points.count()
    if not 0 < k < n / 2:
        raise ValueError(f"k must be positive and below half the {n} points")
    ranks = intruder_ranks(points, exact_knn(as_points(layout), k), metric)
    scale = 2.0 / (float(n) * k * (2.0 * n - 3.0 * k - 1.0))
    excess = F.greatest(F.col("rank") - F.lit(k), F.lit(0))
    return ranks.agg((F.lit(1.0) - F.lit(scale) * F.sum(excess)).alias("trustworthiness"))


def trustworthiness_of(
    points: DataFrame, layouts: dict[str, DataFrame], k: int = 15, metric: str = "euclidean"
) -> DataFrame:
    """(name, trustworthiness) of several layouts of the same points.

    A pair of points that is close in several layouts is ranked once, and all ranks are counted in one pass over the
    points, whose distances cost more than further thresholds.
    """
    n = points.count()
    if not 0 < k < n / 2:
        raise ValueError(f"k must be positive and below half the {n} points")
    scratch = Scratch(points.sparkSession, "layouts")
    near = reduce(DataFrame.unionByName, [
        scratch.save(exact_knn(as_points(layout), k).select(F.lit(name).alias("name"), "i", "j"), f"near{at}")
        for at, (name, layout) in enumerate(layouts.items())
    ])
    pairs = near.select("i", "j").distinct().withColumn("rank", F.col("j"))
    ranks = scratch.save(intruder_ranks(points, pairs, metric), "ranks")
    scale = 2.0 / (float(n) * k * (2.0 * n - 3.0 * k - 1.0))
    excess = F.greatest(F.col("rank") - F.lit(k), F.lit(0))
    return near.join(ranks, ["i", "j"]).groupBy("name").agg(
        (F.lit(1.0) - F.lit(scale) * F.sum(excess)).alias("trustworthiness")
    )


def procrustes_similarity(first: DataFrame, second: DataFrame, n_components: int) -> float:
    """1 - disparity of two layouts (id, y) after centring, scaling and the best rotation.

    Equals the squared nuclear norm of the scaled cross products, so one Gram matrix suffices.
    """
    other = second.select("id", F.col("y").alias("z"))
    both = first.join(other, "id").select(F.concat("y", "z").alias("v"))
    _, _, cov = gram(both, 2 * n_components)
    d = n_components
    sizes = np.trace(cov[:d, :d]), np.trace(cov[d:, d:])
    if min(sizes) <= 0:
        raise ValueError("a layout with all points in one place cannot be compared")
    singular = np.linalg.svd(cov[:d, d:], compute_uv=False)
    return float(singular.sum() ** 2 / (sizes[0] * sizes[1]))


def pca_procrustes(points: DataFrame, layout: DataFrame) -> DataFrame:
    """One row: agreement of the layout with the PCA of the same number of dimensions."""
    d = layout.select(F.size("y")).first()[0]
    flat = pca(points.select("id", "v"), d).withColumnRenamed("v", "y")
    value = procrustes_similarity(flat, layout, d)
    return points.sparkSession.createDataFrame([(value,)], "pca_procrustes double")


def subsamples(points: DataFrame, repeats: int, size: int, seed: int, hasher: str = "xxhash64") -> DataFrame:
    """(repeat, id): per repeat the ``size`` ids with the smallest draws, without replacement.

    Only ids whose draw is below a bound become rows. The bound is somewhat above what ``size`` of all points need; while
    a repeat has too few ids below it, it is raised, so the sample is exact.
    """
    scratch = Scratch(points.sparkSession, "subsamples")
    n, whole = points.count(), 1 << draws.DRAW_BITS
    u = draws.draw((seed, "sample"), "r", "id", hasher=hasher)
    bound = whole * (size + SAMPLE_MARGIN * (math.isqrt(size) + 1)) // max(n, 1)
    for turn in itertools.count():
        bound = min(bound, whole)
        drawn = f"filter(transform(sequence(0, {repeats - 1}), r -> struct(r AS repeat, {u} AS u)), x -> x.u < {bound}L)"
        hits = points.select("id", F.expr(f"inline({drawn})"))
        found = scratch.save(top_rows(hits, "repeat", ["u", "id"], size, "r").select(
            F.col("repeat").cast("bigint").alias("repeat"), "id"
        ), f"drawn{turn}")
        if bound == whole or found.count() == repeats * min(size, n):
            return found
        bound *= 4
