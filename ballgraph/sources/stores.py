"""Embedding store, report files and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballgraph.operators.labels import path_label
from ballgraph.operators.scores import flatten_report, result_cube, run_of_path
from ballgraph.session import Scratch

RUN_KEYS = ["method", "dataset", "k", "seed"]
CUBE_SCHEMA = "method string, metric string, k bigint, seed bigint, value double, dataset string"
REPORT_TYPE = "map<string,map<string,double>>"
IMAGE_GLOB = "*.{pgm,png,ppm,jpg,jpeg}"


def write_embedding(emb: DataFrame, path: str, method: str, dataset: str, k: int, seed: int) -> None:
    """Adds or replaces one run of the partitioned store."""
    (
        emb.withColumn("method", F.lit(method)).withColumn("dataset", F.lit(dataset))
        .withColumn("k", F.lit(k).cast("bigint")).withColumn("seed", F.lit(seed).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RUN_KEYS).parquet(path)
    )


def read_embeddings(spark: SparkSession, path: str, **run) -> DataFrame:
    """Scan of the store; the run keys given prune partitions."""
    df = spark.read.parquet(path)
    for key, value in run.items():
        if key not in RUN_KEYS:
            raise ValueError(f"unknown run key {key!r}")
        df = df.where(F.col(key) == F.lit(value))
    return df


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """JSON report files as score rows; files with another name are skipped."""
    files = (
        spark.read.option("pathGlobFilter", "*.json").option("wholetext", True).text(folder)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    parsed = files.select(
        run_of_path(F.col("path")).alias("run"),
        F.from_json("value", REPORT_TYPE).alias("report"),
        "path",
    ).where(F.col("run").isNotNull())
    rows = flatten_report(parsed.select("run.*", "report", "path"))
    return rows.select("dataset", "method", "metric", "k", "seed", "value", "path")


def write_reports(scores: DataFrame, path: str) -> None:
    """Scores as JSON lines, one folder and one file per run."""
    scores.repartition("dataset", "k", "seed").write.mode("overwrite").partitionBy("dataset", "k", "seed").json(path)


def write_cube(cube: DataFrame, path: str) -> None:
    cube.write.mode("overwrite").partitionBy("dataset").parquet(path)


def report_state(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, state): a digest of the names, sizes and times of a dataset's report files, which are not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(
        run_of_path(F.col("path")).alias("run"), F.struct("path", "length", "modificationTime").alias("file")
    ).where("run IS NOT NULL")
    return files.groupBy(F.col("run.dataset").alias("dataset")).agg(
        F.sum(F.xxhash64("file").cast("decimal(38,0)")).alias("a"),
        F.sum(F.xxhash64("file", F.lit(1)).cast("decimal(38,0)")).alias("b"),
    ).select("dataset", F.concat_ws("|", "a", "b").alias("state"))


def merge_reports(
    spark: SparkSession, reports: str, path: str, methods: list[str], metrics: list[str], neighbors: list[int],
    seeds: list[int],
) -> DataFrame:
    """The cube of a folder of report files, kept at ``path``: only datasets whose files differ from the last merge are
    read and written again, the partitions of all others stay as they are.

    What was merged lies beside the cube and is written after it, so a merge that was cut off is done again. Another grid
    merges everything again; a dataset whose reports are gone keeps its cells.
    """
    grid = repr([sorted(map(str, x)) for x in (methods, metrics, neighbors, seeds)])
    scratch = Scratch(spark, "cube", folder=f"{path}-merged")
    now = report_state(spark, reports).withColumn("grid", F.lit(grid))
    done = sorted(int(name) for name in scratch.names())
    if done:
        before = spark.read.schema(now.schema).parquet(scratch.path(str(done[-1])))
    else:
        before = now.limit(0)
    turn = str(done[-1] + 1 if done else 0)
    changed = Scratch(spark, "changed").save(now.join(before, ["dataset", "state", "grid"], "left_anti"), "datasets")
    if not changed.isEmpty():
        fresh = read_reports(spark, reports).join(changed.select("dataset"), "dataset", "left_semi")
        cube = result_cube(fresh, methods, metrics, neighbors, seeds, latest="path")
        cube.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)
        kept = before.join(changed.select("dataset"), "dataset", "left_anti")
        scratch.save(kept.unionByName(changed), turn)
        for old in done:
            scratch.drop(str(old))
    return spark.read.schema(CUBE_SCHEMA).parquet(path)


def labelled_files(spark: SparkSession, folder: str) -> DataFrame:
    """Image files below a folder with the label from their name; unlabelled names are skipped."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", IMAGE_GLOB).load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", path_label(name).alias("label"), "content").where("label is not null")
