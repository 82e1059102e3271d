"""From raw tables to points and labels: the recipes of the usual kinds of input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.operators import counts as C
from ballgraph.operators import scaling as S
from ballgraph.operators import text as X
from ballgraph.operators.community import communities
from ballgraph.operators.graph import fuzzy_union, memberships, smooth_knn
from ballgraph.operators.knn import neighbour_lists
from ballgraph.operators.labels import label_index, one_hot
from ballgraph.operators.linalg import pca, truncated_svd
from ballgraph.operators.neighbours import knn
from ballgraph.session import Scratch
from ballgraph.sources.points import assemble


def text_points(
    docs: DataFrame, col: str = "text", n_components: int = 128, max_features: int | None = 200_000,
    min_df: int = 2, stop_words: list[str] = X.STOP_WORDS, normalize: bool = True, seed: int = 0,
) -> DataFrame:
    """(id, v): TF-IDF of (id, text), or the numbers given, reduced by SVD, rows of length 1.

    Documents without any kept term get a zero row.
    """
    terms = X.vectorize(docs, col, stop_words, min_df, max_features)
    rows, _ = truncated_svd(terms, n_components, seed=seed, ids=docs)
    return S.l2_normalize(rows) if normalize else rows


def count_points(
    counts: DataFrame, n_top: int = 2000, n_components: int = 50, do_scale: bool = False
) -> DataFrame:
    """(id, v): counts (id, feature, value) -> equal totals, log, most variable features, PCA."""
    ids = counts.select("id").distinct()
    n_rows = ids.count()
    scratch = Scratch(counts.sparkSession, "counts")
    logged = scratch.save(C.log1p(C.normalize_total(counts)), "logged")
    top = C.highly_variable(logged, n_rows, n_top).select("feature").collect()  # n_top names
    rows = scratch.save(C.dense_rows(logged, sorted(r.feature for r in top), ids), "rows")
    if do_scale:
        rows = C.scale_clip(rows, n_rows)
    return pca(rows, min(n_components, len(top)), len(top))


def cluster_labels(
    points: DataFrame, k: int = 15, resolution: float = 1.0, method: str = "exact", seed: int = 0
) -> DataFrame:
    """(id, label): communities of the fuzzy neighbour graph, numbered from 0.

    A point without an edge is a community of its own.
    """
    near = knn(points, k, method, seed=seed)
    graph = fuzzy_union(memberships(smooth_knn(neighbour_lists(near), k)))
    found = communities(graph, resolution, seed=seed)
    every = points.select("id").join(found, "id", "left").select("id", F.coalesce("c", "id").alias("c"))
    return label_index(every, "c", "label").select("id", "label")


def table_points(
    df: DataFrame, id_col: str, categorical: list[str], numeric: list[str],
    one_hot_categoricals: bool = True, standardize: bool = True,
) -> DataFrame:
    """(id, v) of a mixed table: numbers, one column per category level, standardised."""
    columns = list(numeric)
    if one_hot_categoricals and categorical:
        df, columns = one_hot(df.select(id_col, *categorical, *numeric), categorical, numeric)
    points = assemble(df, F.col(id_col), [f"`{c}`" for c in columns])
    return S.standardize(points) if standardize else points
