"""Neighbours among points that share a random-projection bucket in any of several tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions.arrow import add_columns, list_array
from ballgraph.functions.vectors import list_matrix
from ballgraph.operators import probe as P
from ballgraph.operators.knn import searched, top_rows


def bucket_keys(points: DataFrame, projections: np.ndarray, shifts: np.ndarray, tables: int) -> DataFrame:
    """Adds ``keys``: per table a hash of the floored projections (projections in units of the
    bucket width)."""
    shared = points.sparkSession.sparkContext.broadcast((projections, shifts))

    def run(batch):
        p, s = shared.value
        cells = np.floor(list_matrix(batch.column("v")) @ p + s).astype(np.int64)
        cells = cells.reshape(len(cells), tables, -1)
        mix = np.random.default_rng(1).integers(1, 2 ** 62, size=cells.shape[2]) | 1
        with np.errstate(over="ignore"):
            keys = (cells * mix).sum(axis=2) + np.arange(tables) * np.int64(0x9E3779B97F4A7C)
        return {"keys": list_array(keys.ravel(), np.full(len(cells), tables))}

    return add_columns(points, [], run, {"keys": "array<bigint>"})


def lsh_knn(points: DataFrame, k: int, metric: str = "euclidean", seed: int = 0, tables: int = 8,
            hashes: int = 4, width: float | None = None) -> DataFrame:
    """k nearest among the points that share a bucket.

    ``width`` is the bucket width; the default is the spread of the data along one projection. A
    bucket of any size is split into chunks whose queries are split again. A point without company
    gets fewer neighbours.
    """

    def search(vectors, n, dims, keep, scratch):
        rng = np.random.default_rng(seed)
        directions = rng.normal(size=(dims, tables * hashes))
        shifts = rng.uniform(size=tables * hashes)
        unit = width or _spread(vectors)
        keyed = scratch.save(bucket_keys(vectors, directions / unit, shifts, tables), "keyed")
        rows = keyed.select("id", "v", F.explode("keys").alias("key"))
        # a bucket with the same points as one of another table has no other pairs, so one of them is enough
        sizes = keyed.select("id", F.explode("keys").alias("key")).groupBy("key").agg(
            F.count("*").alias("count"), *[F.bit_xor(F.xxhash64(F.lit(c), "id")).alias(f"set{c}") for c in (0, 1)]
        ).where("count > 1")
        most = P.chunk_rows(dims)
        shared = sizes.groupBy("count", "set0", "set1").agg(F.min("key").alias("key")).selectExpr(
            "key", f"ceil(count / {most}) AS chunks", f"CAST(ceil(count / {P.SPLIT_QUERIES}) AS int) AS parts"
        )
        rows = rows.join(shared, "key")
        members = rows.selectExpr("xxhash64(key, pmod(xxhash64(id), chunks)) AS chunk", "id", "v", "parts")
        visits = rows.selectExpr("key", "id", "v", "parts", "explode(sequence(0L, chunks - 1)) AS c")
        queries = visits.selectExpr(
            "xxhash64(key, c) AS chunk", "id", "v", "parts", "array(double('inf')) AS aux"
        )
        found = P.probe(members, queries, n * tables, P.nearest_work(keep, metric), P.NEAREST_SCHEMA)
        once = found.groupBy("q", "m").agg(F.min("d").alias("d"))
        return top_rows(once, "q", ["d", "m"], keep, "r").select("q", "m", "d")

    return searched(points, k, metric, search, "lsh")


def _spread(vectors: DataFrame) -> float:
    """Root of the mean variance per position times the root of the width: the std of a projection."""
    from ballgraph.operators.scaling import column_moments

    std = np.array(column_moments(vectors).first()["std"])
    return float(np.sqrt((std ** 2).sum())) or 1.0
