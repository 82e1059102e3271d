"""Inverted-list search: k-means lists, and product-quantised members."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions.arrow import add_columns, list_array
from ballgraph.functions.vectors import list_matrix
from ballgraph.operators import probe as P
from ballgraph.operators.knn import searched, top_rows
from ballgraph.operators.linalg import PARTIAL_SCHEMA, folded

# Fixed values of the index.
MAX_LISTS = 4096
N_PROBE = 64
CODE_WORDS = 256     # 8-bit codes
MIN_SUBSPACES = 8


def centres(points: DataFrame, n: int, n_centres: int, seed: int, iterations: int = 10) -> np.ndarray:
    """k-means centres of all rows."""
    train = points.select(array_to_vector("v").alias("x"))
    model = KMeans(k=n_centres, seed=seed, maxIter=iterations, initMode="random", featuresCol="x").fit(train)
    return np.array(model.clusterCenters())


def list_count(n: int, n_lists: int = MAX_LISTS) -> int:
    return max(1, min(n_lists, n // 2))


def _bounded_lists(n: int, width: int, n_lists: int | None) -> int:
    """The number asked for; without one, as many as the broadcast of the centres allows."""
    most = max(1, P.PIVOT_ENTRIES // max(width, 1))
    if n_lists is None:
        return min(list_count(n), most)
    if n_lists > most:
        raise ValueError(f"{n_lists} lists of {width} columns are more than the {most} that can be broadcast")
    return list_count(n, n_lists)


def ivf_knn(points: DataFrame, k: int, metric: str = "euclidean", seed: int = 0,
            n_lists: int | None = None, n_probe: int = N_PROBE, iterations: int = 10,
            pivots: np.ndarray | None = None) -> DataFrame:
    """Neighbours among the members of the ``n_probe`` lists nearest to each point.

    All lists probed gives the exact answer. Long lists are split into chunks, so they cost time but
    do not fill a task. ``pivots`` are centres known beforehand, one list each.
    """
    given = pivots

    def search(vectors, n, width, keep, scratch):
        pivots = given
        if pivots is None:
            pivots = centres(vectors, n, _bounded_lists(n, width, n_lists), seed, iterations)
        members, cells = P.split_cells(scratch.save(P.assign_cells(vectors, pivots), "cells"), pivots, n)
        members = scratch.save(members, "members")
        queries = members.select("id", "v", F.array(F.lit(float("inf"))).alias("aux"))
        plan = lambda rows: P.plan_by_lists(rows, cells, n_probe)
        found = P.probe_planned(
            members, queries, n, len(cells), plan, P.nearest_work(keep, metric), P.NEAREST_SCHEMA
        )
        return top_rows(found, "q", ["d", "m"], keep, "r").select("q", "m", "d")

    return searched(points, k, metric, search, "ivf")


def subspaces(width: int, m: int | None = None) -> list[slice]:
    """Consecutive slices of the positions; sizes differ by at most one."""
    m = min(width, m or max(MIN_SUBSPACES, round(math.sqrt(width))))
    ends = np.cumsum([len(part) for part in np.array_split(np.arange(width), m)])
    return [slice(int(a), int(b)) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]


def train_codebooks(points: DataFrame, n: int, slices: list[slice], seed: int, iterations: int = 10) -> list[np.ndarray]:
    """One k-means per slice, at most 256 centres each, all slices in the same passes.

    Tasks add up their points per centre; only centres and counts reach the driver.
    """
    spark, width = points.sparkSession, slices[-1].stop
    words = min(CODE_WORDS, n)
    train = points.select("v").persist()
    start = P.hash_pivots(points, words, width, seed)
    books = [start[:, s] for s in slices]
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(books)

        def assign(batches):
            counts = np.zeros((len(slices), words))
            sums = np.zeros((words, width))
            for batch in batches:
                x = list_matrix(batch.column("v"))
                if not len(x):
                    continue
                codes = _codes(x, slices, shared.value)
                for c, s in enumerate(slices):
                    counts[c] += np.bincount(codes[:, c], minlength=words)
                    np.add.at(sums[:, s], codes[:, c], x[:, s])
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([1.0]), "total": pa.array([counts.ravel()]), "cross": pa.array([sums.ravel()]),
            })

        _, counts, sums = folded(train.mapInArrow(assign, PARTIAL_SCHEMA))
        counts, sums = counts.reshape(len(slices), words), sums.reshape(words, width)
        books = [
            np.where(counts[c][:, None] > 0, sums[:, s] / np.maximum(counts[c], 1.0)[:, None], books[c])
            for c, s in enumerate(slices)
        ]
    train.unpersist()
    return books


def _codes(x: np.ndarray, slices: list[slice], books: list[np.ndarray]) -> np.ndarray:
    return np.stack([
        P._pivot_distances(x[:, s], book).argmin(axis=1) for s, book in zip(slices, books)
    ], axis=1)


def encode(points: DataFrame, slices: list[slice], books: list[np.ndarray]) -> DataFrame:
    """Replaces v by ``codes``, the nearest centre number per slice."""
    shared = points.sparkSession.sparkContext.broadcast(books)

    def run(batch):
        codes = _codes(list_matrix(batch.column("v")), slices, shared.value)
        return {"codes": list_array(codes.ravel().astype(np.int32), np.full(len(codes), codes.shape[1]))}

    return add_columns(points, ["v"], run, {"codes": "array<int>"})


def _residuals(assigned: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(.., v) minus the pivot of its cell."""
    shared = assigned.sparkSession.sparkContext.broadcast(pivots)

    def run(batch):
        x = list_matrix(batch.column("v")) - shared.value[batch.column("cell").to_numpy()]
        return {"v": list_array(x.ravel(), np.full(len(x), x.shape[1]))}

    return add_columns(assigned, ["v"], run, {"v": "array<double>"})


def ivfpq_knn(points: DataFrame, k: int, metric: str = "euclidean", seed: int = 0,
              n_lists: int | None = None, n_probe: int = N_PROBE, m: int | None = None,
              iterations: int = 10, refine: int = 0) -> DataFrame:
    """Inverted lists whose members travel as product-quantised residuals of their list's centre.

    A chunk is decoded once in its task; a query's distance to a decoded member is the usual
    asymmetric distance. ``refine`` > 0 measures the best ``refine`` * k candidates exactly; where these are all rows,
    the exact vectors travel with the codes, so candidates are measured in their chunk and no pair is written out.
    """

    def search(vectors, n, width, keep, scratch):
        wide = keep * refine if refine else keep
        pivots = centres(vectors, n, _bounded_lists(n, width, n_lists), seed, iterations)
        assigned = scratch.save(P.assign_cells(vectors, pivots), "cells")
        members, cells = P.split_cells(assigned, pivots, n)
        rest = scratch.save(_residuals(members.select("id", "v", "cell", "chunk"), pivots), "residuals")
        slices = subspaces(width, m)
        books = train_codebooks(rest, n, slices, seed, iterations)
        whole = refine and wide >= n  # no list of candidates can be cut: they are measured where they are found
        coded = encode(rest, slices, books).select("id", "chunk", F.col("codes").cast("array<double>").alias("v"))
        if whole:
            coded = coded.join(vectors.select("id", F.col("v").alias("exact")), "id").select(
                "id", "chunk", F.concat("v", "exact").alias("v")
            )
        coded = scratch.save(coded, "codes")
        shared = vectors.sparkSession.sparkContext.broadcast((cells.cell, pivots, books))

        def decode(chunk, codes):
            cell, coarse, words = shared.value
            parts = [book[codes[:, s].astype(np.int64)] for s, book in enumerate(words)]
            decoded = np.concatenate(parts, axis=1) + coarse[cell[chunk]]
            return np.concatenate([decoded, codes[:, len(words):]], axis=1)

        queries = vectors.select("id", "v", F.array(F.lit(float("inf"))).alias("aux"))
        plan = lambda rows: P.plan_by_lists(rows, cells, n_probe)
        work = refined_work(keep, metric) if whole else P.nearest_work(wide, metric)
        found = P.probe_planned(coded, queries, n, len(cells), plan, work, P.NEAREST_SCHEMA, decode)
        best = top_rows(found, "q", ["d", "m"], keep if whole else wide, "r").select("q", "m", "d")
        if whole or not refine:
            return best
        return top_rows(measured(best, vectors, metric), "q", ["d", "m"], keep, "r").select("q", "m", "d")

    return searched(points, k, metric, search, "ivfpq")


def refined_work(keep: int, metric: str) -> Callable:
    """The ``keep`` nearest by exact distance, of members that hold their decoded and their exact vector.

    For candidate lists as long as the table: every member is a candidate, so the decoded distances cut none.
    """

    def work(mid, m):
        _, exact = np.split(m, 2, axis=1)
        return P.nearest_work(keep, metric)(mid, np.ascontiguousarray(exact))

    return work


def measured(pairs: DataFrame, vectors: DataFrame, metric: str) -> DataFrame:
    """(q, m) with their exact distance d."""
    rows = pairs.select("q", "m").join(
        vectors.select(F.col("id").alias("m"), F.col("v").alias("vm")), "m"
    ).join(vectors.select(F.col("id").alias("q"), F.col("v").alias("vq")), "q")

    def run(batch):
        vq, vm = list_matrix(batch.column("vq")), list_matrix(batch.column("vm"))
        return {"d": pa.array(P.pair_distance(vq, vm, metric))}

    return add_columns(rows, ["vq", "vm"], run, {"d": "double"})


