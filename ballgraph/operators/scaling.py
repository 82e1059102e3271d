"""Vector rescaling: constant, global min-max, per-column standardisation, row norms."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array, array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions import vectors as V

MINMAX_FLOOR = 1e-8


def rescale(points: DataFrame, c: float) -> DataFrame:
    return points.withColumn("v", V.divide(F.col("v"), c))


def minmax_global(points: DataFrame) -> DataFrame:
    """(x - min) / (max - min + floor) with one min and one max over every entry of the table."""
    span = points.agg(
        F.struct(
            F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")
        ).alias("s")
    ).scalar()
    scaled = points.withColumn("_s", span)
    return scaled.withColumn(
        "v",
        F.transform(
            "v",
            lambda x: (x - F.col("_s.lo")) / (F.col("_s.hi") - F.col("_s.lo") + F.lit(MINMAX_FLOOR)),
        ),
    ).drop("_s")


def column_moments(points: DataFrame) -> DataFrame:
    """One row ``(n, mean ARRAY, std ARRAY)``; population std, partial aggregates per task."""
    vec = array_to_vector(F.col("v"))
    stats = points.agg(
        Summarizer.metrics("count", "mean", "variance").summary(vec).alias("s")
    )
    n = F.col("s.count")
    shrink = (n - F.lit(1)) / n
    return stats.select(
        n.alias("n"),
        vector_to_array("s.mean").alias("mean"),
        F.transform(vector_to_array("s.variance"), lambda x: F.sqrt(x * shrink)).alias("std"),
    )


def standardize(points: DataFrame) -> DataFrame:
    """Mean 0 and population std 1 per position; positions without spread are only centred."""
    moments = column_moments(points).select(F.struct("mean", "std").alias("m")).scalar()
    return points.withColumn("_m", moments).withColumn(
        "v",
        F.zip_with(
            F.zip_with("v", F.col("_m.mean"), lambda x, m: x - m),
            F.col("_m.std"),
            lambda x, s: F.when(s > 0, x / s).otherwise(x),
        ),
    ).drop("_m")


def standardize_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same for a wide table of numeric columns, all in one aggregate."""
    parts = []
    for c in columns:
        parts += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    stats = df.agg(F.struct(*parts).alias("s")).scalar()
    out = df.withColumn("_s", stats)
    for c in columns:
        std = F.col(f"_s.{c}_std")
        out = out.withColumn(
            c, (F.col(c) - F.col(f"_s.{c}_mean")) / F.when(std > 0, std).otherwise(1.0)
        )
    return out.drop("_s")


def l2_normalize(points: DataFrame) -> DataFrame:
    return points.withColumn("v", V.l2_normalised(F.col("v")))
