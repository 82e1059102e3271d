"""Persistence diagrams of sub-samples and their distances. Every group is one sub-sample, whose
size is a parameter; the sub-samples are independent and run in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions.vectors import l2_normalised
from ballgraph.operators.evaluation import as_points, subsamples
from ballgraph.operators.forest import spanning_forest
from ballgraph.session import Scratch

MEDIAN_FLOOR = 1e-12
SAMPLE_LIMIT = 4000   # a sub-sample's distance matrix must fit one task

DIAGRAM_SCHEMA = "repeat bigint, space string, dim bigint, birth double, death double"


def _distances(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        d = 1.0 - x @ x.T
    else:
        x = x - x.mean(axis=0)  # far from the origin the squares would cancel
        sq = (x * x).sum(axis=1)
        d = np.sqrt(np.maximum(sq[:, None] + sq - 2.0 * (x @ x.T), 0.0))
    d = np.maximum((d + d.T) / 2.0, 0.0)
    np.fill_diagonal(d, 0.0)
    return d


def _median(d: np.ndarray) -> float:
    return max(float(np.median(d[np.triu_indices(len(d), 1)])), MEDIAN_FLOOR)


def merge_heights(d: np.ndarray) -> np.ndarray:
    """Edge lengths of a minimum spanning tree, the deaths of dimension 0."""
    reach, inside = d[0].copy(), np.zeros(len(d), dtype=bool)
    inside[0] = True
    out = np.empty(len(d) - 1)
    for n in range(len(d) - 1):
        reach[inside] = np.inf
        near = int(reach.argmin())
        out[n], inside[near] = reach[near], True
        reach = np.minimum(reach, d[near])
    return np.sort(out)


def loop_bars(d: np.ndarray) -> np.ndarray:
    """(birth, death) of dimension 1 of the Rips filtration, over Z2, zero-length bars left out.

    Edges are taken from long to short and each is paired with its first free triangle; when that
    triangle is taken, the columns are added. Edges that join components are skipped.
    """
    m = len(d)
    ei, ej = np.triu_indices(m, 1)
    order = np.lexsort((ej, ei, d[ei, ej]))
    ei, ej = ei[order], ej[order]
    rank = np.zeros((m, m), dtype=np.int64)
    rank[ei, ej] = rank[ej, ei] = np.arange(len(ei))
    root, tree = np.arange(m), np.zeros(len(ei), dtype=bool)
    for e, (a, b) in enumerate(zip(ei, ej)):
        if root[a] != root[b]:
            root[root == root[a]], tree[e] = root[b], True

    def column(e: int) -> set:
        """Triangles over edge e, keyed so that the smallest key enters the filtration first."""
        a, b = ei[e], ej[e]
        last = np.maximum(np.maximum(rank[a], rank[b]), e)
        last[[a, b]] = -1
        ks = np.flatnonzero(last >= 0)
        tri = np.sort(np.stack([np.full(len(ks), a), np.full(len(ks), b), ks]), axis=0)
        return set((last[ks] * m ** 3 + (tri[0] * m + tri[1]) * m + tri[2]).tolist())

    owner: dict[int, set] = {}
    bars = []
    for e in range(len(ei) - 1, -1, -1):
        if tree[e]:
            continue
        work = column(e)
        while work:
            first = min(work)
            other = owner.get(first)
            if other is None:
                owner[first] = work
                death = first // m ** 3
                if death > e and d[ei[death], ej[death]] > d[ei[e], ej[e]]:
                    bars.append((d[ei[e], ej[e]], d[ei[death], ej[death]]))
                break
            work = work ^ other
    return np.array(sorted(bars)).reshape(-1, 2)


def _diagram(pdf: pd.DataFrame, metric: str, max_dim: int) -> pd.DataFrame:
    d = _distances(np.stack(pdf["v"].to_numpy()), metric)
    d = d / _median(d)
    parts = [np.column_stack([np.zeros(len(d) - 1), merge_heights(d)])]
    if max_dim >= 1:
        parts.append(loop_bars(d))
    rows = np.concatenate(parts)
    return pd.DataFrame({
        "repeat": pdf["repeat"].iloc[0], "space": pdf["space"].iloc[0],
        "dim": np.repeat(np.arange(len(parts)), [len(p) for p in parts]),
        "birth": rows[:, 0], "death": rows[:, 1],
    })


def sampled_vectors(points: DataFrame, sample: DataFrame, space: str) -> DataFrame:
    """(repeat, space, id, v) of a sample. Repeats times size rows are few: they go to the points."""
    return points.join(F.broadcast(sample), "id").select("repeat", F.lit(space).alias("space"), "id", "v")


def both_spaces(
    points: DataFrame, layout: DataFrame, repeats: int, size: int, seed: int, metric: str = "euclidean",
    hasher: str = "xxhash64",
) -> DataFrame:
    """The same sub-samples from the points ('high') and the layout ('low')."""
    if size > SAMPLE_LIMIT:
        raise ValueError(f"a sub-sample has at most {SAMPLE_LIMIT} points")
    if size < 2:
        raise ValueError("a sub-sample needs two points")
    sample = subsamples(points, repeats, size, seed, hasher)
    high = points.select("id", l2_normalised(F.col("v")).alias("v") if metric == "cosine" else "v")
    return sampled_vectors(high, sample, "high").unionByName(
        sampled_vectors(as_points(layout), sample, "low")
    )


def _metric_of(space: str, metric: str) -> str:
    return metric if space == "high" else "euclidean"


def medians(samples: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(repeat, space, median): the median distance between two points of a sub-sample."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        space = pdf["space"].iloc[0]
        d = _distances(np.stack(pdf["v"].to_numpy()), _metric_of(space, metric))
        return pd.DataFrame({"repeat": [pdf["repeat"].iloc[0]], "space": [space], "median": [_median(d)]})

    return samples.groupBy("repeat", "space").applyInPandas(run, "repeat bigint, space string, median double")


def diagrams(samples: DataFrame, max_dim: int = 1, metric: str = "euclidean") -> DataFrame:
    """Finite bars of every sub-sample, distances in units of its median distance."""
    if max_dim not in (0, 1):
        raise ValueError("diagrams of dimension 0 and 1 are built")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _diagram(pdf, _metric_of(pdf["space"].iloc[0], metric), max_dim)

    return samples.groupBy("repeat", "space").applyInPandas(run, DIAGRAM_SCHEMA)


def sample_distances(samples: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(repeat, space, i, j, d), i < j: all distances inside sub-samples, whose size is bounded by SAMPLE_LIMIT."""
    other = samples.selectExpr("repeat", "space", "id AS j", "v AS vj")
    pairs = samples.selectExpr("repeat", "space", "id AS i", "v AS vi").join(other, ["repeat", "space"]).where("i < j")
    straight = "sqrt(aggregate(zip_with(vi, vj, (x, y) -> (x - y) * (x - y)), 0D, (a, x) -> a + x))"
    angle = "greatest(1D - aggregate(zip_with(vi, vj, (x, y) -> x * y), 0D, (a, x) -> a + x), 0D)"
    d = f"CASE WHEN space = 'high' THEN {angle} ELSE {straight} END" if metric == "cosine" else straight
    return pairs.selectExpr("repeat", "space", "i", "j", f"{d} AS d")


def component_bars(samples: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Bars of dimension 0 of every sub-sample: edge lengths of its minimum spanning tree over its median distance."""
    pairs = Scratch(samples.sparkSession, "bars").save(sample_distances(samples, metric), "pairs")
    middle = pairs.groupBy("repeat", "space").agg(F.greatest(F.median("d"), F.lit(MEDIAN_FLOOR)).alias("median"))
    tree = spanning_forest(pairs.selectExpr("struct(repeat, space) AS g", "i", "j", "d AS w"))
    return tree.selectExpr("g.repeat AS repeat", "g.space AS space", "w").join(
        F.broadcast(middle), ["repeat", "space"]  # one row per sub-sample
    ).selectExpr("repeat", "space", "0L AS dim", "0D AS birth", "w / median AS death")


def line_transport(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of two diagrams whose births are all 0: deaths match in order or go to the diagonal."""
    a, b = np.sort(a), np.sort(b)
    drop = np.concatenate([[0.0], np.cumsum(b / np.sqrt(2.0))])
    row = drop.copy()
    for x in a:
        new = row + x / np.sqrt(2.0)
        new[1:] = np.minimum(new[1:], row[:-1] + np.abs(x - b))
        row = np.minimum.accumulate(new - drop) + drop
    return float(row[-1])


def assignment_cost(cost: np.ndarray) -> float:
    """Least total cost of a perfect matching of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.full(n + 1, -1)
    for i in range(n):
        match[n] = i
        col, low, back = n, np.full(n, np.inf), np.full(n, n)
        used = np.zeros(n + 1, dtype=bool)
        while match[col] >= 0:
            used[col] = True
            row = match[col]
            gap = cost[row] - u[row] - v[:n]
            better = ~used[:n] & (gap < low)
            low[better], back[better] = gap[better], col
            nxt = int(np.where(used[:n], np.inf, low).argmin())
            delta = low[nxt]
            u[match[used]] += delta
            v[used] -= delta
            low[~used[:n]] -= delta
            col = nxt
        while col != n:
            match[col] = match[back[col]]
            col = back[col]
    rows = match[:n]
    return float(cost[rows, np.arange(n)].sum())


def transport(a: np.ndarray, b: np.ndarray) -> float:
    """Wasserstein distance of two diagrams: unmatched bars go to the diagonal at length / sqrt(2)."""
    if not len(a) or not len(b):
        return float((np.concatenate([a, b]) @ np.array([-1.0, 1.0])).sum() / np.sqrt(2.0))
    if not a[:, 0].any() and not b[:, 0].any():
        return line_transport(a[:, 1], b[:, 1])
    n, m = len(a), len(b)
    cost = np.zeros((n + m, n + m))
    cost[:n, :m] = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    cost[:n, m:] = ((a[:, 1] - a[:, 0]) / np.sqrt(2.0))[:, None]
    cost[n:, :m] = ((b[:, 1] - b[:, 0]) / np.sqrt(2.0))[None]
    return assignment_cost(cost)


def diagram_distances(bars: DataFrame, repeats: int, max_dim: int) -> DataFrame:
    """(repeat, dim, distance) between the two spaces; a pair without any bar has distance 0."""
    spark = bars.sparkSession
    wanted = spark.range(repeats).select(
        F.col("id").alias("repeat"), F.explode(F.sequence(F.lit(0), F.lit(max_dim))).alias("dim")
    ).withColumn("dim", F.col("dim").cast("bigint"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {s: pdf.loc[pdf["space"] == s, ["birth", "death"]].to_numpy() for s in ("high", "low")}
        return pd.DataFrame({
            "repeat": [pdf["repeat"].iloc[0]], "dim": [pdf["dim"].iloc[0]],
            "distance": [transport(side["high"], side["low"])],
        })

    found = bars.groupBy("repeat", "dim").applyInPandas(run, "repeat bigint, dim bigint, distance double")
    return wanted.join(found, ["repeat", "dim"], "left").select(
        "repeat", "dim", F.coalesce("distance", F.lit(0.0)).alias("distance")
    )


def mean_distances(distances: DataFrame) -> DataFrame:
    return distances.groupBy("dim").agg(F.avg("distance").alias("distance"))
