"""Choice of the neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ballgraph.operators.knn import exact_knn

METHODS = ("exact", "nndescent", "flat", "ivf", "ivfpq", "lsh")


def knn(points: DataFrame, k: int, method: str = "exact", metric: str = "euclidean", seed: int = 0,
        **options) -> DataFrame:
    """(i, j, rank, d). ``flat`` is another name of ``exact``."""
    if method in ("exact", "flat"):
        return exact_knn(points, k, metric, seed)
    if method == "nndescent":
        from ballgraph.operators.nndescent import nndescent_knn

        return nndescent_knn(points, k, metric, seed, **options)
    if method == "ivf":
        from ballgraph.operators.ivf import ivf_knn

        return ivf_knn(points, k, metric, seed, **options)
    if method == "ivfpq":
        from ballgraph.operators.ivf import ivfpq_knn

        return ivfpq_knn(points, k, metric, seed, **options)
    if method == "lsh":
        from ballgraph.operators.lsh import lsh_knn

        return lsh_knn(points, k, metric, seed, **options)
    raise ValueError(f"unknown neighbour method {method!r}; use one of {METHODS}")
