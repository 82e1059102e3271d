"""Registered queries: scans, scaling, labels, text, counts and score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballgraph.functions import kernels
from ballgraph.operators import counts as C
from ballgraph.operators import labels as L
from ballgraph.operators import scaling as S
from ballgraph.operators import scores as R
from ballgraph.operators import text as X
from ballgraph.plans.catalog import Tables, long_vectors, query, rounded, sql_rounded as r_
from ballgraph.plans.datasets import count_points, table_points, text_points
from ballgraph.sources import stores
from ballgraph.sources.points import assemble

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ID = "l_orderkey * 8 + l_linenumber"
SQL_LINE_ID = f"({LINE_ID})"
MAX_FEATURES = 2000
CELL_FEATURES = 40
SQL_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)

SQL_POINTS = """pts AS (
    SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
  cells AS (
    SELECT id, (generate_subscripts(v, 1) - 1)::BIGINT AS pos, unnest(v) AS x FROM pts)"""

SQL_LINES = f"""lines AS (
    SELECT {SQL_LINE_ID} AS id, [{", ".join(f"{c}::DOUBLE" for c in LINE_COLUMNS)}] AS v
    FROM lineitem),
  cells AS (
    SELECT id, (generate_subscripts(v, 1) - 1)::BIGINT AS pos, unnest(v) AS x FROM lines)"""

SQL_TOKENS = f"""tok AS (
    SELECT id, term FROM (
      SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
      FROM documents)
    WHERE term NOT IN ({SQL_STOP})),
  tc AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL)"""


def line_points(t: Tables):
    return assemble(t["lineitem"], F.expr(LINE_ID), LINE_COLUMNS)


def doc_counts(t: Tables):
    return X.term_counts(X.tokens(t.docs()))


def cell_counts(t: Tables):
    """Documents as cells and their terms as features."""
    return doc_counts(t).select("id", F.col("term").alias("feature"), F.col("tf").alias("value"))


@query("q_points", f"""WITH {SQL_POINTS}
SELECT id, label, len(v)::BIGINT AS width, {r_("list_sum(v)")} AS total FROM pts""")
def _points(t):
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return t.points().select(
        "id", "label", F.size("v").cast("bigint").alias("width"), rounded(total).alias("total")
    )


@query("q_assemble", f"WITH {SQL_LINES} SELECT id, pos, x FROM cells")
def _assemble(t):
    return line_points(t).select("id", F.posexplode("v").alias("pos", "x")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query("q_rescale", f"WITH {SQL_POINTS} SELECT id, pos, {r_('x / 255.0', 9)} AS x FROM cells")
def _rescale(t):
    return long_vectors(S.rescale(t.vectors(), 255.0), 9)


@query("q_minmax_global", f"""WITH {SQL_POINTS}, s AS (SELECT min(x) AS lo, max(x) AS hi FROM cells)
SELECT id, pos, {r_("(x - lo) / (hi - lo + 1e-8)")} AS x FROM cells, s""")
def _minmax(t):
    return long_vectors(S.minmax_global(t.vectors()))


@query("q_standardize", f"""WITH {SQL_POINTS},
  s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM cells GROUP BY pos)
SELECT id, pos, {r_("(x - m) / (CASE WHEN sd > 0 THEN sd ELSE 1 END)")} AS x
FROM cells JOIN s USING (pos)""")
def _standardize(t):
    return long_vectors(S.standardize(t.vectors()))


@query("q_standardize_wide", "WITH s AS (SELECT " + ", ".join(
    f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(LINE_COLUMNS))
    + f" FROM lineitem) SELECT {SQL_LINE_ID} AS id, " + ", ".join(
    r_(f"({c} - m{i}) / (CASE WHEN d{i} > 0 THEN d{i} ELSE 1 END)") + f" AS {c}"
    for i, c in enumerate(LINE_COLUMNS)) + " FROM lineitem, s")
def _standardize_wide(t):
    lines = t["lineitem"].select(F.expr(LINE_ID).alias("id"), *LINE_COLUMNS)
    scaled = S.standardize_columns(lines, LINE_COLUMNS)
    return scaled.select("id", *[rounded(c).alias(c) for c in LINE_COLUMNS])


@query("q_l2_normalize", f"""WITH {SQL_LINES},
  n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM lines)
SELECT id, (generate_subscripts(v, 1) - 1)::BIGINT AS pos,
  unnest(list_transform(v, lambda x: round(CASE WHEN len > 0 THEN x / len ELSE x END, 9) + 0.0)) AS x
FROM n""")
def _l2(t):
    return long_vectors(S.l2_normalize(line_points(t)), 9)


@query("q_label_index", """
SELECT p_partkey AS id, p_brand, code FROM part
JOIN (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code
      FROM (SELECT DISTINCT p_brand FROM part)) USING (p_brand)""")
def _label_index(t):
    coded = L.label_index(t["part"].select("p_partkey", "p_brand"), "p_brand")
    return coded.select(F.col("p_partkey").alias("id"), "p_brand", "code")


@query("q_label_index_missing", """
SELECT d.doc_id AS id, coalesce(code, -1) AS code FROM documents d LEFT JOIN labels USING (doc_id)
LEFT JOIN (SELECT quality, dense_rank() OVER (ORDER BY quality) - 1 AS code
           FROM (SELECT DISTINCT quality FROM labels WHERE quality IS NOT NULL)) USING (quality)""")
def _label_missing(t):
    rows = t["documents"].select("doc_id").join(t["labels"].select("doc_id", "quality"), "doc_id", "left")
    coded = L.label_index(rows, "quality", missing=-1)
    return coded.select(F.col("doc_id").alias("id"), "code")


@query("q_label_remap", "SELECT p_partkey AS id, CASE WHEN p_size = 10 THEN 0 ELSE p_size END AS y FROM part")
def _label_remap(t):
    return t["part"].select(
        F.col("p_partkey").alias("id"), L.remap(F.col("p_size"), {10: 0}).alias("y")
    )


@query("q_path_label", r"""
SELECT page_id AS id, regexp_extract(url, '/(\d+)', 1)::BIGINT - 1 AS y FROM pages
WHERE regexp_extract(url, '/(\d+)', 1) <> ''""")
def _path_label(t):
    y = L.path_label(F.col("url"), r"/(\d+)")
    return t["pages"].select(F.col("page_id").alias("id"), y.alias("y")).where(F.col("y").isNotNull())


@query("q_dominant_label", """
WITH long AS (
  SELECT doc_id AS id, 0 AS label, quality AS value FROM labels
  UNION ALL SELECT doc_id, 1, toxic FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, label) AS rn FROM long)
SELECT id, label FROM r WHERE rn = 1""")
def _dominant(t):
    both = F.array(
        F.struct(F.lit(0).alias("label"), F.col("quality").alias("value")),
        F.struct(F.lit(1).alias("label"), F.col("toxic").alias("value")),
    )
    rows = t["labels"].select(F.col("doc_id").alias("id"), F.inline(both))
    return L.dominant_label(rows)


@query("q_display_names", """
SELECT event_id AS id,
  CASE event_type WHEN 'click' THEN 'Clicks' ELSE event_type END AS method,
  CASE event_type WHEN 'click' THEN 'Clicks' ELSE replace(event_type || '_' || user_id, '_', ' ') END AS metric
FROM events""")
def _display_names(t):
    key = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(
        F.concat_ws("_", "event_type", F.col("user_id").cast("string"))
    )
    names = {"click": "Clicks"}
    return t["events"].select(
        F.col("event_id").alias("id"),
        L.display_name(F.col("event_type"), names, spaces=False).alias("method"),
        L.display_name(key, names, spaces=True).alias("metric"),
    )


@query("q_run_name", r"""
WITH f AS (
  SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'out/' || event_type || '.json'
    ELSE 'out/' || event_type || '__' || json_extract_string(props, '$.k') || '__' || (user_id % 5) || '.json'
    END AS path FROM events)
SELECT id, regexp_extract(path, '([^/\\]+)__(\d+)__(\d+)\.json$', 1) AS dataset,
  regexp_extract(path, '([^/\\]+)__(\d+)__(\d+)\.json$', 2)::BIGINT AS k,
  regexp_extract(path, '([^/\\]+)__(\d+)__(\d+)\.json$', 3)::BIGINT AS seed
FROM f WHERE regexp_extract(path, '([^/\\]+)__(\d+)__(\d+)\.json$', 1) <> ''""")
def _run_name(t):
    k = F.get_json_object("props", "$.k")
    run = F.concat_ws("__", "event_type", k, (F.col("user_id") % 5).cast("string"))
    name = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(run)
    files = t["events"].select(
        F.col("event_id").alias("id"), F.concat(F.lit("out/"), name, F.lit(".json")).alias("path")
    )
    runs = files.select("id", R.run_of_path(F.col("path")).alias("run"))
    return runs.where(F.col("run").isNotNull()).select("id", "run.*")


@query("q_one_hot", """
WITH lv AS (
  SELECT 'p_brand_' || p_brand AS feature, p_brand AS b, NULL AS ty FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT 'p_type_' || p_type, NULL, p_type FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey AS id, feature,
  CASE WHEN p_brand = b OR p_type = ty THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x
FROM part, lv
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice::DOUBLE FROM part
UNION ALL SELECT p_partkey, 'p_size', p_size::DOUBLE FROM part""")
def _one_hot(t):
    src = t["part"].select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_retailprice", "p_size")
    wide, names = L.one_hot(src, ["p_brand", "p_type"], ["p_retailprice", "p_size"])
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("x")) for n in names])
    return wide.select("id", F.inline(cells))


@query("q_phi", f"""
SELECT event_id AS id, {r_("1.0 / (1.0 + value * value)", 9)} AS student,
  {r_("exp(-value / 10.0)", 9)} AS expo FROM events""")
def _phi(t):
    return t["events"].select(
        F.col("event_id").alias("id"),
        rounded(F.expr(kernels.phi("value", "student")), 9).alias("student"),
        rounded(F.expr(kernels.phi("value", "exp", 10.0)), 9).alias("expo"),
    )


@query("q_tokens", f"WITH {SQL_TOKENS} SELECT id, term, tf FROM tc")
def _tokens(t):
    return doc_counts(t)


SQL_VOCAB = f"""vocab AS (
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tc GROUP BY term HAVING count(*) >= 2
    ORDER BY total DESC, term LIMIT {MAX_FEATURES})"""


@query("q_vocab", f"WITH {SQL_TOKENS}, {SQL_VOCAB} SELECT term, df, total FROM vocab")
def _vocab(t):
    return X.vocabulary(doc_counts(t), 2, MAX_FEATURES)


SQL_TFIDF = f"""{SQL_VOCAB},
  raw AS (SELECT id, term,
      tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS raw
    FROM tc JOIN vocab USING (term)),
  lens AS (SELECT id, sqrt(sum(raw * raw)) AS len FROM raw GROUP BY id)"""


def doc_tfidf(t: Tables):
    return X.tfidf(doc_counts(t), t["documents"].count(), 2, MAX_FEATURES)


@query("q_tfidf", f"""WITH {SQL_TOKENS}, {SQL_TFIDF}
SELECT id, term, {r_("raw / len")} AS value FROM raw JOIN lens USING (id)""")
def _tfidf(t):
    return doc_tfidf(t).withColumn("value", rounded("value"))


SQL_LOGGED = """tot AS (SELECT id, sum(tf) AS total FROM tc GROUP BY id),
  lg AS (SELECT id, term AS feature, ln(1 + tf * 1e4::DOUBLE / total) AS value FROM tc JOIN tot USING (id))"""


def logged_counts(t: Tables):
    return C.log1p(C.normalize_total(cell_counts(t)))


@query("q_norm_total", f"""WITH {SQL_TOKENS}, {SQL_LOGGED}
SELECT id, feature, {r_("value")} AS value FROM lg""")
def _norm_total(t):
    return logged_counts(t).withColumn("value", rounded("value"))


SQL_HVG = """n AS (SELECT count(*)::DOUBLE AS n FROM documents),
  mo AS (SELECT feature, sum(exp(value) - 1) AS s, sum((exp(value) - 1) * (exp(value) - 1)) AS ss
    FROM lg GROUP BY feature),
  st AS (SELECT feature, greatest(s / n, 1e-12) AS m, (ss - s * s / n) / (n - 1) AS var FROM mo, n),
  ds AS (SELECT feature, ln(1 + m) AS mean, CASE WHEN var > 0 THEN ln(var / m) END AS dispersion FROM st),
  sp AS (SELECT min(mean) AS lo, max(mean) AS hi FROM ds),
  bn AS (SELECT ds.*, greatest(ceil((mean - lo) / (hi - lo) * 20) - 1, 0) AS bin FROM ds, sp),
  bs AS (SELECT bin, avg(dispersion) AS bm, stddev_samp(dispersion) AS bsd FROM bn GROUP BY bin),
  nm AS (SELECT feature, mean, dispersion,
      CASE WHEN bsd IS NULL THEN CASE WHEN dispersion IS NOT NULL THEN 1.0::DOUBLE END
           WHEN bsd > 0 THEN (dispersion - bm) / bsd END AS norm
    FROM bn JOIN bs USING (bin))"""


@query("q_hvg", f"""WITH {SQL_TOKENS}, {SQL_LOGGED}, {SQL_HVG}
SELECT feature, {r_("mean")} AS mean, {r_("dispersion")} AS dispersion, {r_("norm")} AS norm FROM nm""")
def _hvg(t):
    n = t["documents"].count()
    ranked = C.dispersions(logged_counts(t), n)
    return ranked.select(
        "feature", *[rounded(c).alias(c) for c in ("mean", "dispersion", "norm")]
    )


@query("q_scale_clip", f"""WITH {SQL_TOKENS}, {SQL_LOGGED},
  top AS (SELECT feature, (row_number() OVER (ORDER BY feature) - 1)::BIGINT AS pos FROM (
    SELECT feature FROM lg GROUP BY feature ORDER BY count(*) DESC, feature LIMIT {CELL_FEATURES})),
  grid AS (SELECT doc_id AS id, feature, pos FROM documents, top),
  cell AS (SELECT g.id, pos, coalesce(value, 0.0) AS x FROM grid g LEFT JOIN lg USING (id, feature)),
  s AS (SELECT pos, avg(x) AS m, stddev_samp(x) AS sd FROM cell GROUP BY pos)
SELECT id, pos, {r_("least((x - m) / (CASE WHEN sd > 0 THEN sd ELSE 1 END), 3.0)")} AS x
FROM cell JOIN s USING (pos)""")
def _scale_clip(t):
    logged = logged_counts(t)
    common = logged.groupBy("feature").count().orderBy(F.desc("count"), "feature").limit(CELL_FEATURES)
    features = sorted(r.feature for r in common.collect())
    ids = t.docs().select("id")
    rows = C.dense_rows(logged, features, ids)
    return long_vectors(C.scale_clip(rows, t["documents"].count(), 3.0))


SQL_SCORES = """sc AS (
    SELECT 'events' AS dataset, event_type AS method, 'value' AS metric,
      json_extract_string(props, '$.k')::BIGINT AS k, user_id % 5 AS seed, value, event_id
    FROM events)"""
CUBE_METHODS = ["click", "view", "absent"]
CUBE_SEEDS = [0, 1, 2, 3, 4]


def event_scores(t: Tables):
    return t["events"].select(
        F.lit("events").alias("dataset"),
        F.col("event_type").alias("method"),
        F.lit("value").alias("metric"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (F.col("user_id") % 5).alias("seed"),
        "value",
        "event_id",
    )


@query("q_run_grid", """
SELECT dataset, k::BIGINT AS k, seed::BIGINT AS seed FROM (SELECT DISTINCT source AS dataset FROM documents),
  (SELECT unnest([2, 3, 5, 8, 13, 21, 34, 55]) AS k), (SELECT unnest([0, 1, 2, 3, 4]) AS seed)""")
def _run_grid(t):
    return R.run_grid(t["documents"].select(F.col("source").alias("dataset")))


@query("q_json_scan", """
SELECT event_id AS id, event_type AS method, 'k' AS metric,
  json_extract_string(props, '$.k')::DOUBLE AS value FROM events""")
def _json_scan(t):
    body = F.concat(F.lit('{"'), F.col("event_type"), F.lit('": '), F.col("props"), F.lit("}"))
    parsed = t["events"].select(
        F.col("event_id").alias("id"),
        F.from_json(body, "map<string,map<string,double>>").alias("report"),
    )
    return R.flatten_report(parsed)


SQL_CUBE = f"""{SQL_SCORES},
  want AS (SELECT 'events' AS dataset, m AS method, mt AS metric, k::BIGINT AS k, s::BIGINT AS seed
    FROM (SELECT unnest({CUBE_METHODS}) AS m), (SELECT unnest(['value', 'other']) AS mt),
      (SELECT unnest({R.NEIGHBORS}) AS k), (SELECT unnest({CUBE_SEEDS}) AS s)),
  last AS (SELECT dataset, method, metric, k, seed, arg_max(value, event_id) AS value FROM sc GROUP BY ALL),
  cube AS (SELECT w.*, l.value FROM want w LEFT JOIN last l USING (dataset, method, metric, k, seed))"""


def event_cube(t: Tables):
    return R.result_cube(
        event_scores(t), CUBE_METHODS, ["value", "other"], R.NEIGHBORS, CUBE_SEEDS, latest="event_id"
    )


@query("q_result_cube", f"WITH {SQL_CUBE} SELECT dataset, method, metric, k, seed, value FROM cube")
def _cube(t):
    return event_cube(t)


@query("q_cube_pivot", f"WITH {SQL_CUBE} SELECT dataset, method, metric, k, " + ", ".join(
    f"max(value) FILTER (seed = {s}) AS seed_{s}" for s in CUBE_SEEDS) + " FROM cube GROUP BY ALL")
def _cube_pivot(t):
    return R.cube_pivot(event_cube(t), CUBE_SEEDS)


@query("q_seed_stats", f"""WITH {SQL_SCORES}
SELECT dataset, metric, method, k, {r_("avg(value)")} AS mean, {r_("stddev_samp(value)")} AS std,
  count(value) AS n_seeds FROM sc GROUP BY dataset, metric, method, k""")
def _seed_stats(t):
    return R.seed_stats(event_scores(t)).withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query("q_seed_bands", f"""WITH {SQL_SCORES}
SELECT dataset, metric, method, k, {r_("avg(value)")} AS mean,
  {r_("avg(value) - stddev_samp(value)")} AS lower, {r_("avg(value) + stddev_samp(value)")} AS upper
FROM sc GROUP BY dataset, metric, method, k""")
def _seed_bands(t):
    bands = R.seed_bands(event_scores(t))
    return bands.withColumns({c: rounded(c) for c in ("mean", "lower", "upper")})


@query("q_scatter", f"""WITH {SQL_POINTS}
SELECT id, {r_("v[1]")} AS x0, {r_("v[2]")} AS x1, label FROM pts""")
def _scatter(t):
    points = t.points()
    emb = points.select("id", F.slice("v", 1, 2).alias("y"))
    plot = R.scatter_table(emb, points.select("id", "label"))
    return plot.withColumns({"x0": rounded("x0"), "x1": rounded("x1")})


SQL_TABLE = """lv AS (SELECT 'b' || p_brand AS f, p_brand AS b, NULL AS ty, 2 + row_number() OVER (ORDER BY p_brand) - 1 AS pos
    FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT 't' || p_type, NULL, p_type, 2 + (SELECT count(DISTINCT p_brand) FROM part)
      + row_number() OVER (ORDER BY p_type) - 1 FROM (SELECT DISTINCT p_type FROM part)),
  cells AS (SELECT p_partkey AS id, pos, CASE WHEN p_brand = b OR p_type = ty THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM part, lv
    UNION ALL SELECT p_partkey, 0, p_retailprice::DOUBLE FROM part
    UNION ALL SELECT p_partkey, 1, p_size::DOUBLE FROM part),
  s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM cells GROUP BY pos)"""


@query("q_table_points", f"""WITH {SQL_TABLE}
SELECT id, pos::BIGINT AS pos, {r_("(x - m) / (CASE WHEN sd > 0 THEN sd ELSE 1 END)")} AS x FROM cells JOIN s USING (pos)""")
def _table_points(t):
    return long_vectors(table_points(t["part"], "p_partkey", ["p_brand", "p_type"], ["p_retailprice", "p_size"]))


@query("q_text_points")
def _text_points(t):
    return long_vectors(text_points(t.docs(), n_components=8, max_features=MAX_FEATURES), 5)


@query("q_count_points")
def _count_points(t):
    return long_vectors(count_points(cell_counts(t), n_top=200, n_components=10), 5)


@query("q_one_hot_terms", """
SELECT p_partkey AS id, 'p_brand_' || p_brand AS term, 1.0::DOUBLE AS value FROM part
UNION ALL SELECT p_partkey, 'p_name_' || p_name, 1.0 FROM part""")
def _one_hot_terms(t):
    rows = t["part"].select(F.col("p_partkey").alias("id"), "p_brand", "p_name")
    return L.one_hot_terms(rows, ["p_brand", "p_name"])


@query("q_embedding_store", f"""WITH {SQL_POINTS}
SELECT id, {r_("v[1]")} AS y0, {r_("v[2]")} AS y1, 'first_two' AS method, 5::BIGINT AS k, s::BIGINT AS seed
FROM pts, (SELECT unnest([0, 1]) AS s)""")
def _embedding_store(t):
    path = t.folder_for("store")
    emb = t.points().select("id", F.slice("v", 1, 2).alias("y"))
    for seed in (0, 1, 2):
        stores.write_embedding(emb, path, "first_two", "embeddings", 5, seed)
    rows = stores.read_embeddings(t.spark, path, method="first_two", k=5).where("seed < 2")
    return rows.select(
        "id", *[rounded(F.get("y", F.lit(c))).alias(f"y{c}") for c in (0, 1)], "method",
        F.col("k").cast("bigint").alias("k"), F.col("seed").cast("bigint").alias("seed"),
    )


@query("q_report_store", f"WITH {SQL_SCORES} SELECT method, metric, value, event_id, dataset, k, seed FROM sc")
def _report_store(t):
    path = t.folder_for("reports")
    stores.write_reports(event_scores(t), path)
    schema = f"{R.SCORE_SCHEMA}, event_id bigint"
    return t.spark.read.schema(schema).json(path).select(
        "method", "metric", "value", "event_id", "dataset", "k", "seed"
    )


@query("q_cube_store", f"WITH {SQL_CUBE} SELECT dataset, method, metric, k, seed, value FROM cube")
def _cube_store(t):
    path = t.folder_for("cube")
    stores.write_cube(event_cube(t), path)
    return t.spark.read.parquet(path).select("dataset", "method", "metric", "k", "seed", "value")
