"""Cutting lineage with tables written to the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session. Only a local-mode session may fall back to its own."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ballgraph-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def plain_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session like ``spark`` for chains of stages: planned without inferred filters, whose cost grows with the length
    of the chain. With a number of ``partitions`` for its shuffles it does not plan anew after each stage either."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    other.conf.set("spark.sql.constraintPropagation.enabled", "false")
    if partitions:
        other.conf.set("spark.sql.shuffle.partitions", str(partitions))
        other.conf.set("spark.sql.adaptive.enabled", "false")
        # tasks read as many bytes as each other, with room for whole files, so that there are as many tasks as cores
        other.conf.set("spark.sql.files.openCostInBytes", "65536")
        other.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism * 3 // 4)))
        # these rows are numbers, whose batches their count bounds; to look at their bytes after each row costs more than to send it
        other.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))
    return other


class Scratch:
    """Tables of one run under the checkpoint folder, or in ``folder``, where a later run finds them again.

    ``save`` writes the rows and hands back a scan of them, so later jobs start from files that
    survive lost executors and the plan does not grow with the number of iterations.
    """

    def __init__(self, spark: SparkSession, label: str, folder: str | None = None):
        self.spark = spark
        self.root = folder.rstrip("/") if folder else f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _files(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def has(self, name: str) -> bool:
        """Whether a table was written to its end."""
        fs, path = self._files(f"{name}/_SUCCESS")
        return bool(fs.exists(path))

    def names(self) -> list[str]:
        """The tables that were written to their end."""
        fs, path = self._files()
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [name for name in found if self.has(name)]

    def once(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        """The table of this name if it is there, else what ``make`` gives, written."""
        return self.spark.read.parquet(self.path(name)) if self.has(name) else self.save(make(), name)

    def save_bucketed(self, df: DataFrame, name: str, by: str, part: str) -> str:
        """A table with a folder for each ``part`` whose rows lie in buckets of ``by``, as many as a shuffle has
        partitions: a join by it with a shuffled side moves no row of it. Returns the table's name."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"scratch_{uuid.uuid4().hex}"
        df.repartition(buckets, by).write.partitionBy(part).bucketBy(buckets, by).sortBy(by).option(
            "path", self.path(name)
        ).mode("overwrite").saveAsTable(table)
        return table

    def drop_table(self, table: str, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.drop(name)

    def drop(self, name: str) -> None:
        fs, path = self._files(name)
        fs.delete(path, True)
