"""Registered queries: layout scores and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballgraph.operators import evaluation as E
from ballgraph.operators import topology as T
from ballgraph.plans.catalog import Tables, query, rounded, sql_draw, sql_rounded as r_
from ballgraph.plans.catalog_graph import SQL_PAIRS, SQL_PTS, low_layout
from ballgraph.plans.experiment import run_experiment
from ballgraph.plans.report import LOOP_SAMPLE, evaluate
from ballgraph.sources.points import scan_points

K_TRUST = 15
SEED, REPEATS, SIZE = 3, 30, 100


@query("q_trustworthiness", f"""WITH {SQL_PAIRS},
  rk AS (SELECT i, j, rank() OVER (PARTITION BY i ORDER BY d) AS rank FROM pr),
  lo AS (SELECT i, j FROM (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id
      ORDER BY sqrt((a.v[1] - b.v[1]) ^ 2 + (a.v[2] - b.v[2]) ^ 2), b.id) AS r
    FROM pts a, pts b WHERE a.id <> b.id) WHERE r <= {K_TRUST}),
  n AS (SELECT count(*)::DOUBLE AS n FROM pts)
SELECT {r_(f"1 - 2 / (any_value(n) * {K_TRUST} * (2 * any_value(n) - 3 * {K_TRUST} - 1)) * sum(greatest(rank - {K_TRUST}, 0))", 9)}
  AS trustworthiness FROM lo JOIN rk USING (i, j), n""")
def _trust(t):
    score = E.trustworthiness(t.vectors(), low_layout(t), K_TRUST)
    return score.select(rounded("trustworthiness", 9).alias("trustworthiness"))


@query("q_procrustes", f"""WITH {SQL_PTS},
  m AS (SELECT covar_samp(v[1], v[3]) AS a, covar_samp(v[1], v[4]) AS b, covar_samp(v[2], v[3]) AS c,
      covar_samp(v[2], v[4]) AS d, var_samp(v[1]) + var_samp(v[2]) AS p, var_samp(v[3]) + var_samp(v[4]) AS q FROM pts)
SELECT {r_("(a * a + b * b + c * c + d * d + 2 * abs(a * d - b * c)) / (p * q)", 9)} AS similarity FROM m""")
def _procrustes(t):
    other = t.points().select("id", F.slice("v", 3, 2).alias("y"))
    value = E.procrustes_similarity(low_layout(t), other, 2)
    one = t.spark.createDataFrame([(value,)], "similarity double")
    return one.select(rounded("similarity", 9).alias("similarity"))


@query("q_pca_procrustes")
def _pca_procrustes(t):
    return E.pca_procrustes(t.vectors(), low_layout(t))


SQL_SAMPLE = f"""sm AS (SELECT repeat, id FROM (
    SELECT repeat, id, row_number() OVER (PARTITION BY repeat ORDER BY
      {sql_draw(str(SEED), "'sample'", "repeat", "id")}, id) AS r
    FROM pts, (SELECT unnest(range({REPEATS})) AS repeat)) WHERE r <= {SIZE})"""


@query("q_subsamples", f"WITH {SQL_PTS}, {SQL_SAMPLE} SELECT repeat, id FROM sm")
def _subsamples(t):
    return E.subsamples(t.vectors(), REPEATS, SIZE, SEED, hasher="md5")


def samples(t: Tables):
    return T.both_spaces(t.vectors(), low_layout(t), REPEATS, SIZE, SEED, hasher="md5")


@query("q_pairs_median", f"""WITH {SQL_PTS}, {SQL_SAMPLE},
  sp AS (SELECT repeat, id, 'high' AS space, v FROM sm JOIN pts USING (id)
    UNION ALL SELECT repeat, id, 'low', v[1:2] FROM sm JOIN pts USING (id))
SELECT a.repeat, a.space, {r_("median(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))))")} AS median
FROM sp a JOIN sp b ON a.repeat = b.repeat AND a.space = b.space AND a.id < b.id GROUP BY a.repeat, a.space""")
def _median(t):
    return T.medians(samples(t)).withColumn("median", rounded("median"))


@query("q_h0_diagram", f"""WITH RECURSIVE {SQL_PTS}, {SQL_SAMPLE},
  sp AS (SELECT repeat, id, 'high' AS space, v FROM sm JOIN pts USING (id)
    UNION ALL SELECT repeat, id, 'low', v[1:2] FROM sm JOIN pts USING (id)),
  nu AS (SELECT repeat, space, v, row_number() OVER (PARTITION BY repeat, space ORDER BY id) AS n FROM sp),
  pr AS (SELECT a.repeat, a.space, a.n, b.n AS m, list_distance(a.v, b.v) AS d
    FROM nu a JOIN nu b ON a.repeat = b.repeat AND a.space = b.space),
  md AS (SELECT repeat, space, median(d) AS median FROM pr WHERE n < m GROUP BY repeat, space),
  far AS (SELECT repeat, space, n, list(CASE WHEN m = n THEN 'infinity'::DOUBLE ELSE d END ORDER BY m) AS ds
    FROM pr GROUP BY repeat, space, n),
  prim AS (SELECT repeat, space, 0 AS step, ds AS reach, NULL::DOUBLE AS w FROM far WHERE n = 1
    UNION ALL
    SELECT p.repeat, p.space, step + 1, list_transform(list_zip(reach, ds),
      lambda x: CASE WHEN isinf(x[1]) OR isinf(x[2]) THEN 'infinity'::DOUBLE ELSE least(x[1], x[2]) END), list_min(reach)
    FROM prim p JOIN far f ON p.repeat = f.repeat AND p.space = f.space AND f.n = list_position(reach, list_min(reach))
    WHERE NOT isinf(list_min(reach)))
SELECT repeat, space, 0::BIGINT AS dim, 0.0::DOUBLE AS birth, {r_("w / median")} AS death
FROM prim JOIN md USING (repeat, space) WHERE w IS NOT NULL""")
def _h0(t):
    return T.component_bars(samples(t)).withColumn("death", rounded("death"))


@query("q_h1_diagram")
def _h1(t):
    small = T.both_spaces(t.vectors(), low_layout(t), REPEATS, LOOP_SAMPLE, SEED)
    bars = T.diagrams(small, 1).where("dim = 1")
    return bars.withColumns({c: rounded(c) for c in ("birth", "death")})


@query("q_wasserstein")
def _wasserstein(t):
    bars = T.diagrams(samples(t), 0)
    return T.diagram_distances(bars, REPEATS, 0).withColumn("distance", rounded("distance"))


@query("q_report")
def _report(t):
    layouts = {"first_two": low_layout(t)}
    return evaluate(t.vectors(), layouts, K_TRUST)


GRID_K, GRID_SEEDS = [2, 3], [0, 1]


def axes_layout(points, k, seed):
    """A fixed layout for the oracle: the pair of vector entries that the seed names."""
    return points.select("id", F.slice("v", 2 * seed + 1, 2).alias("y"))


def trust_scores(points, layouts):
    """(method, metric, value) with the one score of the report that SQL can follow cheaply."""
    return E.trustworthiness_of(points, layouts, K_TRUST).select(
        F.col("name").alias("method"), F.lit("trustworthiness").alias("metric"), F.col("trustworthiness").alias("value")
    )


def experiment(t: Tables):
    """Grid, layouts, store, scores, report files, cube and statistics over two seeds and two k."""
    points = scan_points(t.spark, f"{t.folder}/embeddings.parquet", "vec_id", "embedding")
    return run_experiment(
        {"embeddings": points}, {"axes": axes_layout}, t.folder_for("experiment"), GRID_K, GRID_SEEDS,
        ["trustworthiness"], trust_scores,
    )


SQL_GRID = f"""WITH {SQL_PAIRS},
  grid AS (SELECT k, seed FROM (SELECT unnest({GRID_K})::BIGINT AS k), (SELECT unnest({GRID_SEEDS})::BIGINT AS seed)),
  rk AS (SELECT i, j, rank() OVER (PARTITION BY i ORDER BY d) AS rank FROM pr),
  lo AS (SELECT seed, i, j FROM (SELECT seed, a.id AS i, b.id AS j, row_number() OVER (PARTITION BY seed, a.id
      ORDER BY sqrt((a.v[2 * seed + 1] - b.v[2 * seed + 1]) ^ 2 + (a.v[2 * seed + 2] - b.v[2 * seed + 2]) ^ 2), b.id) AS r
    FROM pts a, pts b, (SELECT DISTINCT seed FROM grid) WHERE a.id <> b.id) WHERE r <= {K_TRUST}),
  n AS (SELECT count(*)::DOUBLE AS n FROM pts),
  trust AS (SELECT seed, 1 - 2 / (any_value(n) * {K_TRUST} * (2 * any_value(n) - 3 * {K_TRUST} - 1))
      * sum(greatest(rank - {K_TRUST}, 0)) AS value FROM lo JOIN rk USING (i, j), n GROUP BY seed),
  cube AS (SELECT 'embeddings' AS dataset, 'axes' AS method, 'trustworthiness' AS metric, k, seed, value
    FROM grid JOIN trust USING (seed))"""


@query("q_experiment_cube", f"""{SQL_GRID}
SELECT dataset, method, metric, k, seed, {r_("value", 9)} AS value FROM cube""")
def _experiment_cube(t):
    return experiment(t).cube.select("dataset", "method", "metric", "k", "seed", rounded("value", 9).alias("value"))


@query("q_experiment_stats", f"""{SQL_GRID}
SELECT dataset, metric, method, k, {r_("avg(value)", 9)} AS mean, {r_("stddev_samp(value)", 9)} AS std,
  count(value) AS n_seeds FROM cube GROUP BY dataset, metric, method, k""")
def _experiment_stats(t):
    stats = experiment(t).stats
    return stats.select("dataset", "metric", "method", "k", rounded("mean", 9).alias("mean"), rounded("std", 9).alias("std"), "n_seeds")
