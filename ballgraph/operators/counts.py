"""Count matrices as long tables ``(id, feature, value)`` where absent cells are zeros."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballgraph.functions.arrow import add_columns, list_array
from ballgraph.functions.vectors import list_offsets
from ballgraph.operators.scaling import column_moments
from ballgraph.session import Scratch

# Fixed values of the dispersion ranking.
MEAN_BINS = 20
MEAN_FLOOR = 1e-12


def normalize_total(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Each row scaled to the same total. A row has one cell per feature, which bounds its window."""
    total = F.sum("value").over(Window.partitionBy("id"))
    return counts.select("*", total.alias("total")).select(
        "id", "feature",
        F.when(F.col("total") > 0, F.col("value") * F.lit(float(target)) / F.col("total"))
        .otherwise(F.col("value").cast("double")).alias("value"),
    )


def log1p(counts: DataFrame) -> DataFrame:
    return counts.withColumn("value", F.log1p("value"))


def dispersions(logged: DataFrame, n_rows: int) -> DataFrame:
    """(feature, mean, dispersion, norm): log dispersion as a z-score inside equal-width mean bins.

    Moments are taken on the un-logged values with the implicit zeros counted by ``n_rows``. A bin
    with one feature has no spread: its z-score is 1.
    """
    raw = F.expm1("value")
    n = F.lit(float(n_rows))
    moments = logged.groupBy("feature").agg(F.sum(raw).alias("s"), F.sum(raw * raw).alias("ss"))
    stats = moments.select(
        "feature",
        F.greatest(F.col("s") / n, F.lit(MEAN_FLOOR)).alias("m"),
        ((F.col("ss") - F.col("s") * F.col("s") / n) / (n - F.lit(1.0))).alias("var"),
    ).select(
        "feature",
        F.log1p("m").alias("mean"),
        F.when(F.col("var") > 0, F.log(F.col("var") / F.col("m"))).alias("dispersion"),
    )
    stats = Scratch(logged.sparkSession, "dispersions").save(stats, "moments")  # read three times below
    span = stats.agg(F.struct(F.min("mean").alias("lo"), F.max("mean").alias("hi")).alias("s")).scalar()
    binned = stats.withColumn("_s", span)
    step = F.ceil((F.col("mean") - F.col("_s.lo")) / (F.col("_s.hi") - F.col("_s.lo")) * MEAN_BINS)
    binned = binned.withColumn(
        "bin", F.when(F.col("_s.hi") > F.col("_s.lo"), F.greatest(step - 1, F.lit(0))).otherwise(0)
    ).drop("_s")
    bins = binned.groupBy("bin").agg(
        F.avg("dispersion").alias("bm"), F.stddev_samp("dispersion").alias("bs")
    )
    return binned.join(F.broadcast(bins), "bin").select(  # at most MEAN_BINS rows
        "feature", "mean", "dispersion",
        F.when(F.col("bs").isNull(), F.when(F.col("dispersion").isNotNull(), F.lit(1.0)))
        .when(F.col("bs") > 0, (F.col("dispersion") - F.col("bm")) / F.col("bs")).alias("norm"),
    )


def highly_variable(logged: DataFrame, n_rows: int, n_top: int) -> DataFrame:
    """The ``n_top`` features with the highest normalised dispersion; ties by name."""
    ranked = dispersions(logged, n_rows).where(F.col("norm").isNotNull())
    return ranked.orderBy(F.desc("norm"), "feature").limit(n_top)


def dense_rows(
    counts: DataFrame, features: list[str], ids: DataFrame | None = None
) -> DataFrame:
    """(id, v): one position per listed feature, zeros where a row has no cell.

    Rows without any listed feature stay in when ``ids`` names them.
    """
    width = len(features)
    slots = counts.sparkSession.createDataFrame(list(enumerate(features)), "pos int, feature string")
    placed = counts.join(F.broadcast(slots), "feature")  # the list of columns of the result
    packed = placed.groupBy("id").agg(
        F.collect_list("pos").alias("pos"), F.collect_list("value").alias("x")
    )
    if ids is not None:
        empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
        packed = ids.select("id").join(packed, "id", "left").select("id", empty("pos", "int"), empty("x", "double"))

    def fill(batch):
        out = np.zeros((batch.num_rows, width))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(list_offsets(batch.column("pos"))))
        out[rows, batch.column("pos").flatten().to_numpy()] = batch.column("x").flatten().to_numpy()
        return {"v": list_array(out.ravel(), np.full(len(out), width))}

    return add_columns(packed.select("id", "pos", F.col("x").cast("array<double>")), ["pos", "x"], fill,
                       {"v": "array<double>"})


def scale_clip(rows: DataFrame, n_rows: int, max_value: float = 10.0) -> DataFrame:
    """z-scores by sample std (1 where there is no spread), cut at ``max_value``."""
    grow = F.lit((n_rows / (n_rows - 1.0)) ** 0.5)
    moments = column_moments(rows).select(F.struct("mean", "std").alias("m")).scalar()
    z = F.zip_with(
        F.zip_with("v", F.col("_m.mean"), lambda x, m: x - m),
        F.col("_m.std"),
        lambda x, s: F.when(s > 0, x / (s * grow)).otherwise(x),
    )
    return (
        rows.withColumn("_m", moments)
        .withColumn("v", F.transform(z, lambda x: F.least(x, F.lit(float(max_value)))))
        .drop("_m")
    )
