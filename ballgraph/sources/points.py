"""Point tables ``(id BIGINT, v ARRAY<DOUBLE>[, label])``: scans, dense ids, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballgraph.functions.vectors import as_doubles
from ballgraph.session import Scratch


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores when its files come in fewer pieces; else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_points(
    spark: SparkSession, path: str, id_col: str, vector_col: str, label_col: str | None = None
) -> DataFrame:
    """Only the named columns reach the Parquet scan."""
    cols = [F.col(id_col).cast("bigint").alias("id"), as_doubles(F.col(vector_col)).alias("v")]
    if label_col is not None:
        cols.append(F.col(label_col).cast("bigint").alias("label"))
    return spread(spark.read.parquet(path).select(*cols))


def assemble(df: DataFrame, id_col: Column, columns: list[str]) -> DataFrame:
    """Numeric columns of a wide table as one vector per row."""
    return df.select(
        id_col.cast("bigint").alias("id"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("v"),
    )


def dense_codes(keys: DataFrame, key_col: str, code_col: str, scratch: Scratch) -> DataFrame:
    """Unique keys -> 0..n-1 in key order, without sending all keys through one task.

    Keys are range-partitioned and sorted; each partition numbers its own rows and the partition
    sizes (one row per partition) give the offsets. The numbered rows are written once, so the
    offsets and the rows cannot come from two different partitionings.
    """
    numbered = scratch.save(
        keys.select(key_col)
        .repartitionByRange(key_col)
        .sortWithinPartitions(key_col)
        .select(key_col, F.monotonically_increasing_id().alias("_mid"))
        .select(
            key_col,
            F.shiftright("_mid", 33).alias("_part"),
            F.col("_mid").bitwiseAND((1 << 33) - 1).alias("_row"),
        ),
        f"codes-{code_col}",
    )
    offset, offsets = 0, []
    for part, size in sorted(map(tuple, numbered.groupBy("_part").count().collect())):
        offsets.append((part, offset))
        offset += size
    table = keys.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    return numbered.join(F.broadcast(table), "_part").select(
        key_col, (F.col("_offset") + F.col("_row")).alias(code_col)
    )


def point_shape(points: DataFrame) -> dict:
    """Row count, width range, id range and distinct ids; only ids are shuffled to count them."""
    row = points.agg(
        F.count("*").alias("n"),
        F.min("id").alias("lo"),
        F.max("id").alias("hi"),
        F.min(F.size("v")).alias("min_width"),
        F.max(F.size("v")).alias("max_width"),
        F.count(F.when(F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x)), 1))
        .alias("bad"),
    ).first()
    return row.asDict() | {"ids": points.where("id IS NOT NULL").select("id").distinct().count()}


def validate_points(points: DataFrame, min_width: int = 1) -> dict:
    """Checks an input table and returns its shape; the errors name what is wrong."""
    shape = point_shape(points)
    if shape["n"] == 0:
        raise ValueError("no points")
    if shape["bad"]:
        raise ValueError(f"{shape['bad']} points have missing or NaN entries")
    if shape["ids"] != shape["n"]:
        raise ValueError(f"ids are not unique: {shape['n']} rows, {shape['ids']} ids")
    if shape["min_width"] != shape["max_width"]:
        raise ValueError(f"widths differ: {shape['min_width']} to {shape['max_width']}")
    if shape["min_width"] < min_width:
        raise ValueError(f"width {shape['min_width']} is below {min_width}")
    return shape


def is_dense(shape: dict) -> bool:
    return shape["lo"] == 0 and shape["hi"] == shape["n"] - 1 and shape["ids"] == shape["n"]


def with_positions(
    points: DataFrame, shape: dict, scratch: Scratch
) -> tuple[DataFrame, DataFrame | None]:
    """Points keyed by 0..n-1, and (id, pos) as the way back if the ids were something else."""
    if is_dense(shape):
        return points.select("id", "v"), None
    codes = scratch.save(dense_codes(points.select("id"), "id", "pos", scratch), "positions")
    return points.join(codes, "id").select(F.col("pos").alias("id"), "v"), codes


def out_of_range(knn: DataFrame, points: DataFrame) -> DataFrame:
    """Neighbour rows that name an id which is not a point."""
    ids = points.select(F.col("id").alias("j"))
    return knn.join(ids, "j", "left_anti")


def validate_knn(knn: DataFrame, points: DataFrame) -> None:
    """Raises with up to 10 example rows when a neighbour is not a point."""
    bad = out_of_range(knn, points).select("i", "j").limit(11).collect()
    if bad:
        shown = ", ".join(f"({r.i}, {r.j})" for r in bad[:10])
        more = " and more" if len(bad) > 10 else ""
        raise ValueError(f"neighbours that are not points: {shown}{more}")


def knn_summary(knn: DataFrame, points: DataFrame) -> DataFrame:
    """One row of counts: points, neighbour rows, bad neighbours, width range."""
    bad = out_of_range(knn, points).agg(F.count("*").alias("n_bad"))
    shape = points.agg(
        F.count("*").alias("n_points"),
        F.min(F.size("v")).cast("bigint").alias("min_width"),
        F.max(F.size("v")).cast("bigint").alias("max_width"),
    )
    rows = knn.agg(F.count("*").alias("n_rows"))
    return shape.select(
        "n_points",
        rows.scalar().alias("n_rows"),
        bad.scalar().alias("n_bad"),
        "min_width",
        "max_width",
    )
