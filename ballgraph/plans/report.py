"""The evaluation report of one or several layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.operators import topology as T
from ballgraph.operators.evaluation import pca_procrustes, trustworthiness

# Fixed values of the report.
REPEATS = 30
SAMPLE = 800
LOOP_SAMPLE = 64   # dimension 1 uses smaller sub-samples


def topology_scores(
    points: DataFrame, layout: DataFrame, repeats: int = REPEATS, size: int = SAMPLE,
    loop_size: int = LOOP_SAMPLE, seed: int = 0, metric: str = "euclidean", n: int | None = None,
) -> DataFrame:
    """(metric, value) rows Wass_H0 and Wass_H1, means over the repeats."""
    n = n or points.count()
    parts = []
    for dim, m in ((0, size), (1, loop_size)):
        samples = T.both_spaces(points, layout, repeats, min(m, n), seed, metric)
        bars = T.diagrams(samples, dim, metric).where(F.col("dim") == dim)
        apart = T.diagram_distances(bars, repeats, dim).where(F.col("dim") == dim)
        parts.append(T.mean_distances(apart).select(
            F.lit(f"Wass_H{dim}").alias("metric"), F.col("distance").alias("value")
        ))
    return parts[0].unionByName(parts[1])


def evaluate(
    points: DataFrame, layouts: dict[str, DataFrame], k_trust: int = 15, metric: str = "euclidean",
    topo_samples: int = SAMPLE, loop_samples: int = LOOP_SAMPLE, repeats: int = REPEATS, seed: int = 0,
) -> DataFrame:
    """(method, metric, value): trustworthiness, pca_procrustes, Wass_H0, Wass_H1 per layout."""
    n = points.count()
    rows = []
    for name, layout in layouts.items():
        local = trustworthiness(points, layout, k_trust, metric)
        overall = pca_procrustes(points, layout)
        topo = topology_scores(points, layout, repeats, topo_samples, loop_samples, seed, metric, n)
        scores = [
            df.select(F.lit(df.columns[0]).alias("metric"), F.col(df.columns[0]).alias("value"))
            for df in (local, overall)
        ] + [topo]
        rows += [s.select(F.lit(name).alias("method"), "metric", "value") for s in scores]
    return reduce(DataFrame.unionByName, rows)
