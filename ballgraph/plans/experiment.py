"""The experiment: a grid of runs, their layouts and report files, and the score cube read back from them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballgraph.operators import scores as S
from ballgraph.plans.embed import fit_transform
from ballgraph.plans.report import evaluate
from ballgraph.session import Scratch
from ballgraph.sources.stores import merge_reports, read_embeddings, read_reports, write_embedding

LAYOUTS_AT_ONCE = 8   # layouts scored together

Layout = Callable[[DataFrame, int, int], DataFrame]


def fitted(**params) -> Layout:
    """The embedding fit as a method of an experiment; k and the seed come from the grid."""
    return lambda points, k, seed: fit_transform(points, n_neighbors=k, random_state=seed, **params)


@dataclass
class Experiment:
    scores: DataFrame   # (dataset, method, metric, k, seed, value, path) as read from the reports
    cube: DataFrame     # every expected cell, NULL where a score is missing
    stats: DataFrame    # mean, std and count over seeds


def write_report(spark: SparkSession, folder: str, run, scores: DataFrame) -> str:
    """One file ``<dataset>__<k>__<seed>.json`` of {method: {metric: value}}; a run has few scores."""
    report: dict[str, dict[str, float]] = {}
    for r in scores.collect():
        report.setdefault(r["method"], {})[r["metric"]] = r["value"]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{run['dataset']}__{run['k']}__{run['seed']}.json")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(json.dumps(report).encode()))
    finally:
        out.close()
    return path.toString()


def run_experiment(
    datasets: dict[str, DataFrame], methods: dict[str, Layout], folder: str, neighbors: list[int] | None = None,
    seeds: list[int] | None = None, metrics: list[str] | None = None,
    score: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] = evaluate,
) -> Experiment:
    """Runs every (dataset, k, seed) of the grid with every method, below ``folder``.

    Layouts go to the embedding store and are scored from there, so a run can be scored again without being fitted
    again; the cube and the statistics come from the report files, so runs of several sessions add up, and only datasets
    with new reports are merged again. Up to ``LAYOUTS_AT_ONCE`` layouts of a dataset are scored by one call of ``score``,
    which gets them by names of its own.
    """
    spark = next(iter(datasets.values())).sparkSession
    neighbors, seeds, metrics = neighbors or S.NEIGHBORS, seeds or S.SEEDS, metrics or S.METRICS
    names = spark.createDataFrame([(name,) for name in datasets], "dataset string")
    store, reports = f"{folder}/embeddings", f"{folder}/reports"
    grid = S.run_grid(names, neighbors, seeds).orderBy("dataset", "k", "seed").collect()
    for dataset in datasets:
        points = datasets[dataset].select("id", "v")
        runs = [run for run in grid if run["dataset"] == dataset]
        step = max(1, LAYOUTS_AT_ONCE // max(len(methods), 1))
        for begin in range(0, len(runs), step):
            some, layouts = runs[begin:begin + step], {}
            for nth, run in enumerate(some):
                at = {key: run[key] for key in ("dataset", "k", "seed")}
                for name, method in methods.items():
                    write_embedding(method(points, run["k"], run["seed"]), store, name, **at)
                    layouts[f"{nth} {name}"] = read_embeddings(spark, store, method=name, **at).select("id", "y")
            scores = Scratch(spark, "scores").save(score(points, layouts), "scores")
            for nth, run in enumerate(some):
                mine = scores.where(F.col("method").startswith(f"{nth} "))
                write_report(spark, reports, run, mine.withColumn("method", F.expr(f"substring(method, {len(str(nth)) + 2})")))
    found = read_reports(spark, reports)
    cube = merge_reports(spark, reports, f"{folder}/cube", list(methods), metrics, neighbors, seeds)
    return Experiment(found, cube, S.seed_stats(cube))
