"""Approximate neighbours by descent: neighbours of neighbours are likely neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions import draws
from ballgraph.functions.vectors import list_matrix, list_offsets
from ballgraph.operators import probe as P
from ballgraph.operators.ivf import measured
from ballgraph.operators.knn import searched, top_rows
from ballgraph.sources.points import point_shape, with_positions

PAD_ENTRIES = 2 << 20   # entries of a padded block of pools


def _pairs_of_pools(metric: str, batches):
    """(q, m, d) pairs inside each pool that improve a list, pools of a batch padded into one block."""
    for batch in batches:
        pool = batch.column("pool")
        sizes = np.diff(list_offsets(pool))
        if not len(sizes) or not sizes.any():
            continue
        flat = pool.flatten()
        ids = flat.field("a").to_numpy()
        fresh = flat.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
        reach, vecs = flat.field("reach").to_numpy(), list_matrix(flat.field("v"))
        start = np.concatenate([[0], np.cumsum(sizes)])
        longest = int(sizes.max())
        at_once = max(1, PAD_ENTRIES // (longest * (vecs.shape[1] + longest)))
        for s in range(0, len(sizes), at_once):
            e = min(s + at_once, len(sizes))
            real = np.arange(longest) < sizes[s:e, None]
            spot = np.where(real, start[s:e, None] + np.arange(longest), 0)
            x = vecs[spot]
            inner = x @ x.transpose(0, 2, 1)
            if metric == "cosine":
                d = 1.0 - inner
            else:
                sq = np.einsum("bld,bld->bl", x, x)
                d = np.sqrt(np.maximum(sq[:, :, None] + sq[:, None] - 2.0 * inner, 0.0))
            new = fresh[spot]
            use = real[:, :, None] & real[:, None] & (new[:, :, None] | new[:, None])
            use &= (ids[spot][:, :, None] != ids[spot][:, None]) & (d < reach[spot][:, :, None])
            b, i, j = np.nonzero(use)
            if len(b):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[spot[b, i]]), pa.array(ids[spot[b, j]]), pa.array(d[b, i, j])],
                    ["q", "m", "d"],
                )


def _pools(graph: DataFrame, size: int, seed: int, round_: int) -> DataFrame:
    """(m, a, fresh): a sample of the points that m lists or that list m, fresh ones marked."""
    turned = graph.select(F.col("q").alias("a"), F.col("m").alias("hub"), "fresh")
    both = graph.select(F.col("m").alias("a"), F.col("q").alias("hub"), "fresh").unionByName(turned)
    once = both.groupBy("hub", "a").agg(F.max("fresh").alias("fresh"))
    drawn = once.withColumn("u", F.expr(draws.draw((seed, round_), "hub", "a")))
    fresh = top_rows(drawn.where("fresh"), "hub", ["u", "a"], size, "r")
    known = top_rows(drawn.where("not fresh"), "hub", ["u", "a"], size, "r")
    return fresh.unionByName(known).select("hub", "a", "fresh")


def _start(vectors: DataFrame, n: int, width: int, others: int, metric: str, seed: int, init: str,
           scratch) -> DataFrame:
    """(q, m, d) of the first lists, at most ``others`` each.

    Lists from inside the cells alone would never lead out of them, so a third stays random.
    """
    if init not in ("cells", "random"):
        raise ValueError(f"unknown start {init!r}; use 'cells' or 'random'")
    links = others if init == "random" else max(2, others // 3)
    picks = vectors.select(
        F.col("id").alias("q"), F.explode(F.sequence(F.lit(1), F.lit(links))).alias("r")
    )
    picks = picks.selectExpr("q", f"{draws.pick(n, (seed, 'start'), 'q', 'r')} AS m")
    far = measured(picks.where("q <> m").distinct(), vectors, metric)
    if init == "random":
        return far
    members, cells = P.chunked(vectors, n, width, seed, scratch)
    close = P.probe_own(members, n, len(cells) if cells else 1, P.nearest_work(others, metric))
    close = top_rows(close.where("q <> m"), "q", ["d", "m"], max(1, others - links), "r")
    both = close.select("q", "m", "d").unionByName(far)
    return both.groupBy("q", "m").agg(F.min("d").alias("d"))


def nndescent_knn(points: DataFrame, k: int, metric: str = "euclidean", seed: int = 0,
                  init: str = "cells", pool: int | None = None, max_rounds: int = 12,
                  delta: float = 0.001) -> DataFrame:
    """Lists are improved by comparing the members of sampled pools around every point.

    A pool holds at most ``pool`` fresh and ``pool`` known points, so a point that many list is no
    larger than another. Rounds stop when fewer than ``delta`` * n * k entries changed.
    """
    def search(vectors, n, width, keep, scratch):
        size = pool or max(10, min(30, keep))
        ids, back = with_positions(vectors, point_shape(vectors), scratch)
        ids = scratch.save(ids, "vectors")
        others = keep - 1
        first = _start(ids, n, width, others, metric, seed, init, scratch)
        graph = scratch.save(
            top_rows(first, "q", ["d", "m"], others, "r").select("q", "m", "d", F.lit(True).alias("fresh")),
            "round0",
        )
        for round_ in range(1, max_rounds + 1):
            pools = scratch.save(_pools(graph, size, seed, round_), f"pools{round_}")
            full = F.when(F.count("*") >= others, F.max("d")).otherwise(F.lit(float("inf")))
            reach = graph.groupBy(F.col("q").alias("a")).agg(full.alias("reach"))
            carried = ids.select(F.col("id").alias("a"), "v").join(reach, "a", "left").select(
                "a", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach")
            )
            packed = pools.join(carried, "a").groupBy("hub").agg(
                F.collect_list(F.struct("a", "fresh", "reach", "v")).alias("pool")
            ).select("pool")
            better = packed.mapInArrow(
                lambda batches: _pairs_of_pools(metric, batches), "q bigint, m bigint, d double"
            )
            # Entries that took part in a pool are known from now on.
            used = pools.where("fresh").select(F.col("hub").alias("q"), F.col("a").alias("m"), F.lit(True).alias("used"))
            old = graph.join(used, ["q", "m"], "left").select(
                "q", "m", "d", (F.col("fresh") & F.col("used").isNull()).alias("fresh"), F.lit(0).alias("come")
            )
            new = better.select("q", "m", "d", F.lit(True).alias("fresh"), F.lit(1).alias("come"))
            merged = old.unionByName(new).groupBy("q", "m").agg(
                F.min("d").alias("d"), F.min("fresh").alias("fresh"), F.min("come").alias("come")
            )
            graph = scratch.save(
                top_rows(merged, "q", ["d", "m"], others, "r").select("q", "m", "d", "fresh", "come"),
                f"round{round_}",
            )
            changed = graph.agg(F.sum("come")).first()[0] or 0
            scratch.drop(f"round{round_ - 1}")
            scratch.drop(f"pools{round_}")
            graph = graph.drop("come")
            if changed <= delta * n * others:
                break
        own = ids.select(F.col("id").alias("q"), F.col("id").alias("m"), F.lit(0.0).alias("d"))
        # The rounds measure by matrix products; the final lists are measured again exactly.
        exact = measured(graph, ids, metric).select("q", "m", "d")
        found = exact.unionByName(own)
        if back is None:
            return found
        q = back.select(F.col("pos").alias("q"), F.col("id").alias("qi"))
        m = back.select(F.col("pos").alias("m"), F.col("id").alias("mi"))
        return found.join(q, "q").join(m, "m").select(F.col("qi").alias("q"), F.col("mi").alias("m"), "d")

    return searched(points, k, metric, search, "nndescent")
