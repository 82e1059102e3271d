"""Registry of runnable queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballgraph.functions.vectors import as_doubles
from ballgraph.session import Scratch
from ballgraph.sources.points import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def saved(self, df: DataFrame) -> DataFrame:
        """A written copy of a table that the query reads more than once."""
        return Scratch(self.spark, "query").save(df, "table")

    def folder_for(self, name: str) -> str:
        """A new folder for tables that a query writes and reads back."""
        return Scratch(self.spark, "query").path(name)

    def points(self) -> DataFrame:
        """(id, v, label) of the embeddings table."""
        return self["embeddings"].select(
            F.col("vec_id").alias("id"), as_doubles(F.col("embedding")).alias("v"), "label"
        )

    def vectors(self) -> DataFrame:
        return self.points().select("id", "v")

    def docs(self) -> DataFrame:
        return spread(self["documents"].select(F.col("doc_id").alias("id"), "text"))


def query(name: str, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under a name, with the SQL for the same result."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits) + F.lit(0.0)


def sql_rounded(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def sql_draw(*keys: str) -> str:
    """SQL text of an md5 draw; keys are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 15))::BIGINT"


def sql_uniform(*keys: str) -> str:
    return f"(({sql_draw(*keys)} >> 7)::DOUBLE / 9007199254740992.0)"


def long_vectors(df: DataFrame, digits: int = 6) -> DataFrame:
    """(id, pos, x): one row per vector entry, rounded for comparison."""
    return df.select("id", F.posexplode("v").alias("pos", "x")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), rounded("x", digits).alias("x")
    )
