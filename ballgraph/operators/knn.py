"""k-nearest-neighbour self-joins: ``(i, j, rank, d)`` with self left out, ordered by (d, j)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballgraph.functions.vectors import l2_normalised
from ballgraph.operators import probe as P
from ballgraph.session import Scratch
from ballgraph.sources.points import validate_points

COSINE_EPS = float(np.finfo(np.float32).eps)  # norms are clamped here before dividing
METRICS = ("euclidean", "cosine")
COPY_BYTES = 64 << 20  # of the lists of equal vectors, above which they are not broadcast


def check_args(k: int, metric: str) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")


def top_rows(df: DataFrame, key: str | list[str], order: list[str], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows per key. Spark cuts to ``n`` inside each task before the shuffle, so a
    key with very many rows stays small."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def prepared(points: DataFrame, metric: str) -> DataFrame:
    v = l2_normalised(F.col("v"), COSINE_EPS) if metric == "cosine" else F.col("v")
    return points.select("id", v.alias("v"))


def _copies(points: DataFrame, keep: int, scratch: Scratch, n_hashes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equal vectors as one: (distinct vectors by lowest id, members ``u -> j``, ``i -> u``).

    Only the ``keep`` lowest ids of a vector can be among anyone's ``keep`` nearest by (d, id), so the
    member lists are exact although short. Sorted by a hash first, rows compare whole vectors only where it is equal;
    the result is written, as all three tables come from it. With as many vectors as hashes (``n_hashes``) a hash names
    its vector, and vectors need not be moved again to find their lowest id.
    """
    key = points.withColumn("h", F.xxhash64("v"))
    lowest = top_rows(key, ["h", "v"], ["id"], keep, "r")
    first = F.first("id").over(Window.partitionBy("h", "v").orderBy("id"))
    rows = scratch.save(lowest.select(
        "h", F.col("id").alias("j"), "r", F.when(F.col("r") == 1, F.col("v")).alias("v"), first.alias("u")
    ), "distinct")
    reps = rows.where("r = 1")
    if n_hashes is not None and reps.count() == n_hashes:
        # a vector without a copy is its own lowest id
        several = small_copies(rows.where("r = 2").select("h", "u"), rows.where("r = 2").count())
        owner = key.select("id", "h").join(several, "h", "left").select(F.col("id").alias("i"), F.coalesce("u", "id").alias("u"))
    else:
        owner = key.join(reps.select("h", "v", "u"), ["h", "v"]).select(F.col("id").alias("i"), "u")
    return reps.select(F.col("u").alias("id"), "v"), rows.select("u", "j"), owner


def small_copies(df: DataFrame, n: int, n_ids: int = 0) -> DataFrame:
    """A table of ``n`` vectors with copies and ``n_ids`` ids of them, broadcast below a size."""
    return F.broadcast(df) if 48 * n + 8 * n_ids <= COPY_BYTES else df


def _nearest(points: DataFrame, n: int, width: int, keep: int, metric: str, seed: int,
             scratch: Scratch) -> DataFrame:
    """(q, m, d): the ``keep`` nearest of every point, itself included."""
    work = P.nearest_work(keep, metric)
    members, cells = P.chunked(points, n, width, seed, scratch)
    if cells is None:
        return P.probe_own(members, n, 1, work)
    # Own chunk first: its keep-th distance bounds the search in all other chunks.
    home = scratch.save(P.probe_own(members, n, len(cells), work), "home")
    bound = home.groupBy("q").agg(F.count("*").alias("c"), F.max("d").alias("d"))
    reach = F.when(F.col("c") >= keep, F.col("d")).otherwise(F.lit(float("inf")))
    queries = scratch.save(members.join(bound, members.id == bound.q).select(
        "id", "v", F.array(reach).alias("aux"), F.col("chunk").alias("own")
    ), "queries")
    plan = lambda rows: P.plan_by_bounds(rows, cells, metric, skip_own=True)
    rest = P.probe_planned(members, queries, n, len(cells), plan, work, P.NEAREST_SCHEMA)
    return top_rows(home.unionByName(rest), "q", ["d", "m"], keep, "r").select("q", "m", "d")


def searched(points: DataFrame, k: int, metric: str, search: Callable, label: str) -> DataFrame:
    """Runs ``search(vectors, n, width, keep, scratch) -> (q, m, d)`` and ranks what it finds.

    The search sees every distinct vector once, so a vector with very many copies costs no more than
    another. It returns up to ``keep`` = k+1 members per vector, itself among them.
    """
    check_args(k, metric)
    shape = validate_points(points)
    scratch = Scratch(points.sparkSession, label)
    vectors = prepared(points, metric)
    n, width = shape["n"], shape["max_width"]
    distinct = vectors.select(F.xxhash64("v").alias("h")).distinct().count()
    if distinct == n:
        found = search(vectors, n, width, k + 1, scratch).select(
            F.col("q").alias("i"), F.col("m").alias("j"), "d"
        )
        return ranked(found, k)
    reps, copies, owner = _copies(vectors, k + 1, scratch, distinct)
    near = search(reps, reps.count(), width, k + 1, scratch)
    others = copies.where("u <> j")
    size = others.agg(F.countDistinct("u").alias("n"), F.count("*").alias("ids")).first()
    others = small_copies(others.groupBy("u").agg(F.collect_list("j").alias("js")), size["n"], size["ids"])
    lists = near.join(others, near.m == others.u, "left").selectExpr(
        "q", "explode(concat(array(m), coalesce(js, cast(array() AS array<bigint>)))) AS j", "d"
    )
    # one row per vector meets its copies, so that the lists of all points are not dealt out again
    short = top_rows(lists, "q", ["d", "j"], k + 1, "r").groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("d", "j"))).alias("l")
    )
    found = owner.join(short, owner.u == short.q).selectExpr("i", f"posexplode(slice(filter(l, x -> x.j <> i), 1, {int(k)})) AS (pos, x)")
    return found.select("i", "x.j", (F.col("pos") + 1).alias("rank"), "x.d")


def exact_knn(points: DataFrame, k: int, metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """Exact neighbours; every point gets min(k, n-1) of them."""
    return searched(
        points, k, metric,
        lambda vectors, n, width, keep, scratch: _nearest(vectors, n, width, keep, metric, seed, scratch),
        "knn",
    )


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbour pairs that the other search found."""
    hit = approximate.select("i", "j", F.lit(1.0).alias("hit"))
    return exact.join(hit, ["i", "j"], "left").agg(
        F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")
    )


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Candidate rows (i, j, d) -> the k nearest per point without itself."""
    others = found.where(F.col("i") != F.col("j"))
    return top_rows(others, "i", ["d", "j"], k, "rank").select("i", "j", "rank", "d")


def complete_lists(lists: DataFrame, points: DataFrame) -> DataFrame:
    """(i, js, ds): the lists of all points; those without a neighbour have empty ones."""
    every = points.select(F.col("id").alias("i")).join(lists, "i", "left")
    return every.select(
        "i", F.expr("coalesce(js, cast(array() as array<bigint>))").alias("js"),
        F.expr("coalesce(ds, cast(array() as array<double>))").alias("ds"),
    )


def neighbour_lists(knn: DataFrame) -> DataFrame:
    """(i, js, ds): one row per point, in rank order."""
    packed = knn.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "j", "d"))).alias("l"))
    return packed.select("i", F.col("l.j").alias("js"), F.col("l.d").alias("ds"))
