"""Experiment score tables ``(dataset, method, metric, k, seed, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default experiment.
NEIGHBORS = [2, 3, 5, 8, 13, 21, 34, 55]
SEEDS = [0, 1, 2, 3, 4]
METRICS = ["trustworthiness", "pca_procrustes", "Wass_H0", "Wass_H1"]

# Fixed value: the name of a report file.
REPORT_NAME = r"([^/\\]+)__(\d+)__(\d+)\.json$"

SCORE_SCHEMA = "dataset string, method string, metric string, k bigint, seed bigint, value double"


def _each(values: list, kind: str) -> Column:
    return F.explode(F.array(*[F.lit(x).cast(kind) for x in values]))


def run_grid(
    datasets: DataFrame, neighbors: list[int] | None = None, seeds: list[int] | None = None
) -> DataFrame:
    """One row per (dataset, k, seed) to run. The fixed lists are exploded, not joined."""
    return (
        datasets.select("dataset").distinct()
        .select("dataset", _each(neighbors or NEIGHBORS, "bigint").alias("k"))
        .select("dataset", "k", _each(seeds or SEEDS, "bigint").alias("seed"))
    )


def run_of_path(path: Column) -> Column:
    """(dataset, k, seed) of a report file name; NULL when it does not match."""
    part = lambda n: F.regexp_extract(path, REPORT_NAME, n)
    return F.when(
        part(1) != "",
        F.struct(
            part(1).alias("dataset"),
            part(2).cast("bigint").alias("k"),
            part(3).cast("bigint").alias("seed"),
        ),
    )


def flatten_report(df: DataFrame, report: str = "report") -> DataFrame:
    """A map method -> metric -> value, as one row per value."""
    rest = [c for c in df.columns if c != report]
    return df.select(*rest, F.explode(report).alias("method", "_metrics")).select(
        *rest, "method", F.explode("_metrics").alias("metric", "value")
    )


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def result_cube(
    scores: DataFrame,
    methods: list[str],
    metrics: list[str],
    neighbors: list[int],
    seeds: list[int],
    latest: str | None = None,
) -> DataFrame:
    """Every expected cell of each dataset that occurs; NULL where no score exists.

    Unexpected keys are dropped. Of several scores for one cell the one with the greatest ``latest``
    counts. Scores are reduced to one row per cell before the join, so no cell can be hot.
    """
    cell = ["dataset", "method", "metric", "k", "seed"]
    wanted = (
        scores.select("dataset").distinct()
        .select("dataset", _each(methods, "string").alias("method"))
        .select("*", _each(metrics, "string").alias("metric"))
        .select("*", _each(neighbors, "bigint").alias("k"))
        .select("*", _each(seeds, "bigint").alias("seed"))
    )
    inside = scores.where(
        F.col("method").isin(methods) & F.col("metric").isin(metrics)
        & F.col("k").isin(neighbors) & F.col("seed").isin(seeds)
    )
    value = F.max_by("value", latest) if latest else F.max("value")
    return wanted.join(inside.groupBy(*cell).agg(_known(value).alias("value")), cell, "left")


def cube_pivot(cube: DataFrame, seeds: list[int]) -> DataFrame:
    """One column per seed; the listed values spare Spark a pass to find them."""
    wide = cube.groupBy("dataset", "method", "metric", "k").pivot("seed", seeds).agg(F.first("value"))
    return wide.select(
        "dataset", "method", "metric", "k", *[F.col(str(s)).alias(f"seed_{s}") for s in seeds]
    )


def seed_stats(scores: DataFrame) -> DataFrame:
    """Mean and sample std over the seeds that have a value; one value has no std."""
    v = _known(F.col("value"))
    return scores.groupBy("dataset", "metric", "method", "k").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n_seeds")
    )


def seed_bands(scores: DataFrame) -> DataFrame:
    """Mean minus and plus one std, per curve point."""
    return seed_stats(scores).select(
        "dataset", "metric", "method", "k", "mean",
        (F.col("mean") - F.col("std")).alias("lower"),
        (F.col("mean") + F.col("std")).alias("upper"),
    )


def scatter_table(emb: DataFrame, labels: DataFrame) -> DataFrame:
    """First two coordinates and the label of each point; a point without label keeps NULL."""
    return emb.join(labels, "id", "left").select(
        "id", F.get("y", F.lit(0)).alias("x0"), F.get("y", F.lit(1)).alias("x1"), "label"
    )
