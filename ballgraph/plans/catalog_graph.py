"""Registered queries: neighbours, graphs, layouts and linear algebra."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ballgraph.functions import vectors as V
from ballgraph.operators import community as M
from ballgraph.operators import graph as G
from ballgraph.operators import ivf as I
from ballgraph.operators import knn as K
from ballgraph.operators import layout as Y
from ballgraph.operators import linalg as A
from ballgraph.operators import probe as P
from ballgraph.operators.forest import spanning_forest
from ballgraph.operators.neighbours import knn as knn_by
from ballgraph.plans.catalog import (
    Tables, long_vectors, query, rounded, sql_rounded as r_, sql_uniform,
)
from ballgraph.plans.catalog_features import doc_tfidf
from ballgraph.plans.datasets import cluster_labels
from ballgraph.operators.scaling import standardize_columns
from ballgraph.sources.points import assemble, knn_summary

KNN = 10

SQL_PTS = "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
SQL_PAIRS = f"""{SQL_PTS},
  pr AS (SELECT a.id AS i, b.id AS j,
      sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
    FROM pts a, pts b WHERE a.id <> b.id)"""


def sql_knn(k: int) -> str:
    return f"""{SQL_PAIRS},
  knn AS (SELECT * FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank, d FROM pr)
    WHERE rank <= {k})"""


SQL_KNN = sql_knn(KNN)


def knn(t: Tables, k: int = KNN):
    return K.exact_knn(t.vectors(), k)


@query("q_knn_lines")
def _knn_lines(t):
    """Many points of few columns: too many pairs for SQL, compared with brute force in the tests."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]  # unique together
    lines = t["lineitem"].select(F.xxhash64(*key).alias("id"), *columns)
    points = assemble(standardize_columns(lines, columns), F.col("id"), columns)
    return listed(K.exact_knn(t.saved(points), 5))


@query("q_knn_euclidean", f"WITH {SQL_KNN} SELECT i, j, rank, {r_('d')} AS d FROM knn")
def _knn(t):
    return knn(t).select("i", "j", F.col("rank").cast("bigint").alias("rank"), rounded("d").alias("d"))


@query("q_knn_cosine", f"""WITH {SQL_PTS},
  nm AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM pts),
  pr AS (SELECT a.id AS i, b.id AS j, 1.0 - list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])) AS d
    FROM nm a, nm b WHERE a.id <> b.id)
SELECT * FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank, {r_('d')} AS d FROM pr)
WHERE rank <= {KNN}""")
def _knn_cosine(t):
    near = K.exact_knn(t.vectors(), KNN, "cosine")
    return near.select("i", "j", F.col("rank").cast("bigint").alias("rank"), rounded("d").alias("d"))


def low_layout(t: Tables):
    """A fixed two-column layout: the first two vector entries."""
    return t.points().select("id", F.slice("v", 1, 2).alias("y"))


@query("q_knn_validate", f"""WITH {SQL_KNN}, kept AS (SELECT * FROM pts WHERE label <> 9)
SELECT (SELECT count(*) FROM kept) AS n_points, (SELECT count(*) FROM knn) AS n_rows,
  (SELECT count(*) FROM knn WHERE j NOT IN (SELECT id FROM kept)) AS n_bad,
  64::BIGINT AS min_width, 64::BIGINT AS max_width""")
def _validate(t):
    return knn_summary(knn(t), t.points().where("label <> 9"))


@query("q_knn_edges", f"""WITH {SQL_KNN}
SELECT i, j, {r_("exp(-d / (SELECT max(d) FROM knn))")} AS w FROM knn""")
def _edges(t):
    return G.knn_edges(knn(t), binarize=False).withColumn("w", rounded("w"))


SQL_SMOOTH = f"""lists AS (SELECT i, list(j ORDER BY rank) AS js, list(d ORDER BY rank) AS ds FROM knn GROUP BY i),
  bis AS (
    SELECT i, js, ds, list_min(ds) AS rho, 0.0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1.0::DOUBLE AS mid, 0 AS n FROM lists
    UNION ALL
    SELECT i, js, ds, rho, CASE WHEN big THEN lo ELSE mid END, CASE WHEN big THEN mid ELSE hi END,
      CASE WHEN big THEN (lo + mid) / 2 WHEN isinf(hi) THEN mid * 2 ELSE (mid + hi) / 2 END, n + 1
    FROM (SELECT *, list_sum(list_transform(ds, lambda x: exp(-greatest(x - rho, 0.0) / greatest(mid, 1e-300))))
        > log2({KNN}) AS big FROM bis WHERE n < 64)),
  sm AS (SELECT i, js, ds, rho, greatest(mid, 1e-3 * list_avg(ds)) AS sigma FROM bis WHERE n = 64),
  mem AS (SELECT i, j, CASE WHEN d - rho <= 0 OR sigma <= 0 THEN 1.0 ELSE exp(-(d - rho) / sigma) END AS w
    FROM (SELECT i, unnest(js) AS j, unnest(ds) AS d, rho, sigma FROM sm))"""


def smoothed(t: Tables):
    return G.smooth_knn(K.neighbour_lists(knn(t)), KNN)


@query("q_smooth_knn", f"WITH RECURSIVE {SQL_KNN}, {SQL_SMOOTH} SELECT i, {r_('sigma')} AS sigma, {r_('rho')} AS rho FROM sm")
def _smooth(t):
    return smoothed(t).select("i", rounded("sigma").alias("sigma"), rounded("rho").alias("rho"))


@query("q_membership", f"WITH RECURSIVE {SQL_KNN}, {SQL_SMOOTH} SELECT i, j, {r_('w')} AS w FROM mem")
def _membership(t):
    return G.memberships(smoothed(t)).withColumn("w", rounded("w"))


SQL_UNION = """un AS (
    SELECT i, j, a + b - a * b AS w FROM (
      SELECT coalesce(x.i, y.j) AS i, coalesce(x.j, y.i) AS j, coalesce(x.w, 0) AS a, coalesce(y.w, 0) AS b
      FROM mem x FULL JOIN mem y ON x.i = y.j AND x.j = y.i) WHERE i <> j AND a + b - a * b <> 0)"""


def fuzzy(t: Tables):
    return G.fuzzy_union(G.memberships(smoothed(t)))


@query("q_fuzzy_union", f"WITH RECURSIVE {SQL_KNN}, {SQL_SMOOTH}, {SQL_UNION} SELECT i, j, {r_('w')} AS w FROM un")
def _fuzzy(t):
    return fuzzy(t).withColumn("w", rounded("w"))


@query("q_sym_norm_adj", f"""WITH {SQL_KNN},
  sy AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, 1.0::DOUBLE AS w FROM knn UNION ALL SELECT j, i, 1.0 FROM knn) GROUP BY i, j),
  dg AS (SELECT i, sqrt(greatest(sum(w), 1e-12)) AS r FROM sy GROUP BY i)
SELECT sy.i, sy.j, {r_("w / a.r / b.r")} AS w FROM sy JOIN dg a ON sy.i = a.i JOIN dg b ON sy.j = b.i""")
def _sym_norm(t):
    return G.normalized_adjacency(G.knn_edges(knn(t)))[0].withColumn("w", rounded("w"))


@query("q_gram", f"""WITH {SQL_PTS},
  c AS (SELECT id, (generate_subscripts(v, 1) - 1)::BIGINT AS pos, unnest(v) AS x FROM pts)
SELECT a.pos AS a, b.pos AS b, {r_("avg(a.x)", 8)} AS mean_a, {r_("covar_samp(a.x, b.x)", 8)} AS cov
FROM c a JOIN c b ON a.id = b.id AND a.pos <= b.pos GROUP BY a.pos, b.pos""")
def _gram(t):
    width = t.points().select(F.size("v")).first()[0]
    return A.gram_table(t.vectors(), width).withColumns({c: rounded(c, 8) for c in ("mean_a", "cov")})


@query("q_pca")
def _pca(t):
    return long_vectors(A.pca(t.vectors(), 8), 5)


@query("q_svd")
def _svd(t):
    rows, _ = A.truncated_svd(doc_tfidf(t), 8)
    return long_vectors(rows, 5)


@query("q_init_minmax", f"""WITH {SQL_PTS},
  e AS (SELECT min(v[1]) AS l0, max(v[1]) AS h0, min(v[2]) AS l1, max(v[2]) AS h1 FROM pts)
SELECT id, {r_("10 * (v[1] - l0) / greatest(h0 - l0, 1e-8)")} AS y0,
  {r_("10 * (v[2] - l1) / greatest(h1 - l1, 1e-8)")} AS y1 FROM pts, e""")
def _init_minmax(t):
    box = Y.box_scale(low_layout(t), 2, jitter=0.0, seed=0)
    return two_columns(box)


def two_columns(layout, digits: int = 6):
    return layout.select("id", *[rounded(F.get("y", F.lit(c)), digits).alias(f"y{c}") for c in (0, 1)])


@query("q_init_random", "SELECT vec_id AS id, " + ", ".join(
    r_(f"{sql_uniform('7', chr(39) + 'init' + chr(39), str(c), 'vec_id')} * 20.0 - 10.0") + f" AS y{c}"
    for c in (0, 1)) + " FROM embeddings")
def _init_random(t):
    return two_columns(Y.random_layout(t.vectors(), 2, 7, hasher="md5"))


@query("q_init_pca")
def _init_pca(t):
    return two_columns(Y.pca_layout(t.vectors(), 2, 7), 4)


@query("q_spectral")
def _spectral(t):
    points = t.vectors()
    layout = Y.spectral_layout(points, G.knn_edges(knn(t)), points.count(), 2)
    return two_columns(layout, 3)


@query("q_modularity", f"""WITH RECURSIVE {SQL_KNN}, {SQL_SMOOTH}, {SQL_UNION},
  e AS (SELECT a.label AS ci, b.label AS cj, w FROM un JOIN pts a ON un.i = a.id JOIN pts b ON un.j = b.id),
  c AS (SELECT ci, sum(w) FILTER (ci = cj) AS inside, sum(w) AS total FROM e GROUP BY ci)
SELECT {r_("sum(coalesce(inside, 0)) / sum(total) - sum(total * total) / (sum(total) * sum(total))")} AS modularity FROM c""")
def _modularity(t):
    members = t.points().select("id", F.col("label").alias("c"))
    return M.modularity(fuzzy(t), members).select(rounded("modularity").alias("modularity"))


@query("q_louvain")
def _louvain(t):
    return M.communities(fuzzy(t))


@query("q_knn_recall", f"""WITH {SQL_KNN},
  ap AS (SELECT i, j FROM (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY
      sqrt(list_sum(list_transform(list_zip(a.v[1:32], b.v[1:32]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), b.id) AS r
    FROM pts a, pts b WHERE a.id <> b.id) WHERE r <= {KNN})
SELECT {r_("avg(CASE WHEN ap.i IS NULL THEN 0.0 ELSE 1.0 END)", 9)} AS recall
FROM knn LEFT JOIN ap ON knn.i = ap.i AND knn.j = ap.j""")
def _recall(t):
    half = t.vectors().select("id", F.slice("v", 1, 32).alias("v"))
    return K.recall(K.exact_knn(half, KNN), knn(t)).select(rounded("recall", 9).alias("recall"))


@query("q_ivf_probe", f"""WITH {SQL_PTS},
  c AS (SELECT label, pos, avg(x) AS x FROM (
    SELECT label, (generate_subscripts(v, 1) - 1) AS pos, unnest(v) AS x FROM pts) GROUP BY label, pos),
  cn AS (SELECT label, list(x ORDER BY pos) AS v FROM c GROUP BY label)
SELECT id, cell, rank FROM (SELECT p.id, cn.label::BIGINT AS cell, row_number() OVER (PARTITION BY p.id ORDER BY
    list_sum(list_transform(list_zip(p.v, cn.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), cn.label) AS rank
  FROM pts p, cn) WHERE rank <= 3""")
def _ivf_probe(t):
    near = P.nearest_cells(t.vectors(), label_means(t), 3).select("id", F.posexplode("cells").alias("pos", "cell"))
    return near.select("id", "cell", (F.col("pos") + 1).cast("bigint").alias("rank"))


def listed(near):
    return near.select("i", "j", F.col("rank").cast("bigint").alias("rank"), rounded("d").alias("d"))


@query("q_knn_nndescent")
def _nndescent(t):
    return listed(knn_by(t.vectors(), KNN, "nndescent"))


@query("q_knn_ivf")
def _ivf(t):
    return listed(knn_by(t.vectors(), KNN, "ivf", n_lists=64, n_probe=8))


@query("q_knn_ivfpq")
def _ivfpq(t):
    return listed(knn_by(t.vectors(), KNN, "ivfpq", n_lists=16, n_probe=4, refine=2))


@query("q_knn_lsh")
def _lsh(t):
    return listed(knn_by(t.vectors(), KNN, "lsh", hashes=2))


@query("q_pq_encode")
def _pq(t):
    points = t.vectors()
    width = points.select(F.size("v")).first()[0]
    slices = I.subspaces(width)
    coded = I.encode(points, slices, I.train_codebooks(points, points.count(), slices, 0))
    return coded.select("id", F.posexplode("codes").alias("pos", "code")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query("q_cluster_labels")
def _cluster(t):
    return cluster_labels(t.vectors(), KNN)


SQL_LISTED = f"WITH {SQL_KNN} SELECT i, j, rank, {r_('d')} AS d FROM knn"


@query("q_knn_ivf_all_lists", SQL_LISTED)
def _ivf_all(t):
    return listed(knn_by(t.vectors(), KNN, "ivf", n_lists=12, n_probe=12))


@query("q_knn_ivfpq_all_refined", SQL_LISTED)
def _ivfpq_all(t):
    points = t.vectors()
    return listed(knn_by(points, KNN, "ivfpq", n_lists=4, n_probe=4, refine=points.count()))


@query("q_knn_lsh_one_bucket", SQL_LISTED)
def _lsh_all(t):
    return listed(knn_by(t.vectors(), KNN, "lsh", tables=6, hashes=1, width=1e4))


SQL_LABEL_MEANS = """c AS (SELECT label, pos, avg(x) AS x FROM (
    SELECT label, (generate_subscripts(v, 1) - 1) AS pos, unnest(v) AS x FROM pts) GROUP BY label, pos),
  cn AS (SELECT label, list(x ORDER BY pos) AS v FROM c GROUP BY label)"""


def label_means(t: Tables) -> np.ndarray:
    means = t.points().groupBy("label").agg(
        vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m")
    ).orderBy("label")
    return np.array([r.m for r in means.collect()])


@query("q_pq_codes", f"""WITH {SQL_PTS}, {SQL_LABEL_MEANS}
SELECT id, pos, code FROM (SELECT p.id, s.pos::BIGINT AS pos, cn.label AS code, row_number() OVER (PARTITION BY p.id, s.pos
    ORDER BY list_sum(list_transform(list_zip(p.v[s.pos * 8 + 1:s.pos * 8 + 8], cn.v[s.pos * 8 + 1:s.pos * 8 + 8]),
      lambda p: (p[1] - p[2]) * (p[1] - p[2]))), cn.label) AS r
  FROM pts p, cn, (SELECT unnest(range(8)) AS pos) s) WHERE r = 1""")
def _pq_codes(t):
    """Codes against fixed codebooks, the label means."""
    means = label_means(t)
    slices = I.subspaces(means.shape[1])
    coded = I.encode(t.vectors(), slices, [means[:, s] for s in slices])
    return coded.select("id", F.posexplode("codes").alias("pos", "code")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def products(rows, digits: int = 6):
    """(id, sq, next): squared length of each row and its product with the row of the next id."""
    after = rows.selectExpr("id - 1 AS id", "v AS w")
    return rows.join(after, "id", "left").select(
        "id", rounded(V.dot(F.col("v"), F.col("v")), digits).alias("sq"),
        rounded(V.dot(F.col("v"), F.col("w")), digits).alias("next"),
    )


def sql_products(source: str) -> str:
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
    return (f"SELECT a.id, {r_(dot('a.v', 'a.v'))} AS sq, CASE WHEN b.id IS NOT NULL THEN {r_(dot('a.v', 'b.v'))} END AS next "
            f"FROM {source} a LEFT JOIN {source} b ON b.id = a.id + 1")


@query("q_pca_full", f"""WITH {SQL_PTS},
  m AS (SELECT pos, avg(x) AS m FROM (SELECT generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM pts) GROUP BY pos),
  ml AS (SELECT list(m ORDER BY pos) AS m FROM m),
  ce AS (SELECT id, list_transform(list_zip(v, m), lambda p: p[1] - p[2]) AS v FROM pts, ml)
{sql_products("ce")}""")
def _pca_full(t):
    """All components: a rotation of the centred points keeps their products."""
    points = t.vectors()
    width = points.select(F.size("v")).first()[0]
    return products(t.saved(A.pca(points, width, width)))


@query("q_svd_full", f"WITH {SQL_PTS} {sql_products('pts')}")
def _svd_full(t):
    """All components: the rows U*S keep the products of the input rows."""
    cells = t.vectors().select("id", F.posexplode("v").alias("pos", "value"))
    rows, _ = A.truncated_svd(cells.select("id", F.col("pos").cast("string").alias("term"), "value"), 64)
    return products(t.saved(rows))


LINE_COLUMNS = ["l_quantity", "l_extendedprice / 1000.0", "l_discount * 100.0", "l_tax * 100.0"]


def _sql_power(name: str, matrix, steps: int = 300) -> str:
    """CTEs with the leading eigenvector (u0..u3) and value of a 4 x 4 matrix of SQL expressions over ``cov``."""
    row = lambda r: " + ".join(f"({matrix(r, c)}) * u{c}" for c in range(4))
    size = "sqrt(" + " + ".join(f"y{c} * y{c}" for c in range(4)) + ")"
    return f"""{name}_it AS (SELECT 0 AS step, 0.9::DOUBLE AS u0, 0.8::DOUBLE AS u1, 0.7::DOUBLE AS u2, 0.6::DOUBLE AS u3, 0.0::DOUBLE AS value
      UNION ALL SELECT step + 1, {", ".join(f"y{c} / {size}" for c in range(4))}, {size}
      FROM (SELECT step, {", ".join(f"{row(c)} AS y{c}" for c in range(4))} FROM {name}_it, cov{", first_" if name == "second" else ""}
        WHERE step < {steps})),
  {name}_ AS (SELECT {", ".join(f"u{c} AS {name[0]}{c}" for c in range(4))}, value AS {name[0]}v FROM {name}_it WHERE step = {steps})"""


def _cov(r: int, c: int) -> str:
    return f"c{min(r, c)}{max(r, c)}"


_LINE_COV = ", ".join(f"covar_samp(x{r}, x{c}) AS c{r}{c}" for r in range(4) for c in range(r, 4))
_CENTRED = lambda u: " + ".join(f"(x{c} - m{c}) * {u}{c}" for c in range(4))


@query("q_pca_lines", f"""WITH RECURSIVE
  rows_ AS (SELECT l_orderkey, l_linenumber, {", ".join(f"({e})::DOUBLE AS x{c}" for c, e in enumerate(LINE_COLUMNS))} FROM lineitem),
  mean AS (SELECT {", ".join(f"avg(x{c}) AS m{c}" for c in range(4))} FROM rows_),
  cov AS (SELECT {_LINE_COV} FROM rows_),
  {_sql_power("first", _cov)},
  {_sql_power("second", lambda r, c: f"{_cov(r, c)} - fv * f{r} * f{c}")}
SELECT l_orderkey, l_linenumber, {r_("abs(" + _CENTRED("f") + ")", 5)} AS first, {r_("abs(" + _CENTRED("s") + ")", 5)} AS second
FROM rows_, mean, first_, second_""")
def _pca_lines(t):
    """Two of four components: the size of every row's scores, which depends on components and their order."""
    vector = F.array(*[F.expr(e).cast("double") for e in LINE_COLUMNS])
    points = t["lineitem"].select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_linenumber", vector.alias("v")
    )
    flat = A.pca(points, 2, 4)
    return flat.select(
        "l_orderkey", "l_linenumber", *[rounded(F.abs(F.col("v")[c]), 5).alias(n) for c, n in enumerate(("first", "second"))]
    )


_LINE_PRODUCTS = ", ".join(f"sum(x{r} * x{c}) AS c{r}{c}" for r in range(4) for c in range(r, 4))
_ALONG = lambda u: " + ".join(f"x{c} * {u}{c}" for c in range(4))


@query("q_svd_lines", f"""WITH RECURSIVE
  rows_ AS (SELECT l_orderkey, l_linenumber, {", ".join(f"sum(({e})::DOUBLE) AS x{c}" for c, e in enumerate(LINE_COLUMNS))}
    FROM lineitem GROUP BY l_orderkey, l_linenumber),
  cov AS (SELECT {_LINE_PRODUCTS} FROM rows_),
  {_sql_power("first", _cov)},
  {_sql_power("second", lambda r, c: f"{_cov(r, c)} - fv * f{r} * f{c}")}
SELECT l_orderkey, l_linenumber, {r_("abs(" + _ALONG("f") + ")", 5)} AS first, {r_("abs(" + _ALONG("s") + ")", 5)} AS second
FROM rows_, first_, second_""")
def _svd_lines(t):
    """Two of four components of a sparse table: the numbers of every line are cells, those of one key add up, zeros have none."""
    vector = F.array(*[F.expr(e).cast("double") for e in LINE_COLUMNS])
    cells = t["lineitem"].select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), F.posexplode(vector).alias("pos", "value")
    ).where("value <> 0").select("id", F.concat(F.lit("x"), "pos").alias("term"), "value")
    rows, _ = A.truncated_svd(cells, 2)
    return rows.select(
        F.floor(F.col("id") / 16).alias("l_orderkey"), (F.col("id") % 16).cast("int").alias("l_linenumber"),
        *[rounded(F.abs(F.col("v")[c]), 5).alias(n) for c, n in enumerate(("first", "second"))],
    )


@query("q_spanning_forest", f"""WITH RECURSIVE {SQL_KNN},
  nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM pts),
  es AS (SELECT least(i, j) AS i, greatest(i, j) AS j, min(d) AS w FROM knn GROUP BY ALL),
  ordered AS (SELECT e.*, a.n AS na, b.n AS nb, row_number() OVER (ORDER BY w, i, j) AS step
    FROM es e JOIN nodes a ON a.id = i JOIN nodes b ON b.id = j),
  grown AS (SELECT 0::BIGINT AS step, (SELECT list(n ORDER BY n) FROM nodes) AS root, false AS kept
    UNION ALL
    SELECT o.step, CASE WHEN root[na] = root[nb] THEN root
        ELSE list_transform(root, lambda x: CASE WHEN x = root[na] THEN root[nb] ELSE x END) END, root[na] <> root[nb]
    FROM grown g JOIN ordered o ON o.step = g.step + 1)
SELECT i, j, {r_("w")} AS w FROM ordered JOIN grown USING (step) WHERE kept""")
def _spanning_forest(t):
    """Of the neighbour graph: the heights at which its parts merge."""
    edges = knn(t).selectExpr("0L AS g", "i", "j", "d AS w")
    return spanning_forest(edges).select("i", "j", rounded("w").alias("w"))


@query("q_edges_in_range", f"""WITH {SQL_KNN}
SELECT i, j, 1.0::DOUBLE AS w FROM knn WHERE i < 300 AND j < 300""")
def _edges_in_range(t):
    return G.in_range(G.knn_edges(knn(t)), 300)


PROBED = 3


@query("q_knn_ivf_label_means", f"""WITH {SQL_PTS},
  entries AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM pts),
  centres AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM entries GROUP BY ALL) GROUP BY label),
  ranked AS (SELECT id, label AS cell, row_number() OVER (PARTITION BY id ORDER BY list_distance(v, c), label) AS r
    FROM (SELECT id, v FROM pts), centres),
  pr AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d
    FROM ranked p JOIN ranked h ON p.cell = h.cell AND h.r = 1 AND p.r <= {PROBED} AND p.id <> h.id
    JOIN pts a ON a.id = p.id JOIN pts b ON b.id = h.id)
SELECT * FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank, {r_('d')} AS d FROM pr)
WHERE rank <= {KNN}""")
def _knn_ivf_label_means(t):
    """Fixed centres, the mean of each label, and few probes: the index answers for less than all pairs."""
    cells = t.points().select("label", F.posexplode("v").alias("pos", "x"))
    rows = cells.groupBy("label", "pos").agg(F.avg("x").alias("m")).groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c")
    ).select("label", F.col("c.m").alias("c")).orderBy("label").collect()  # one row per label
    near = I.ivf_knn(t.vectors(), KNN, n_probe=PROBED, pivots=np.array([r["c"] for r in rows]))
    return near.select("i", "j", F.col("rank").cast("bigint").alias("rank"), rounded("d").alias("d"))
