"""Registered queries: triangles, loss, gradient, optimiser steps and the fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballgraph.functions import kernels
from ballgraph.operators import cech as C
from ballgraph.operators import discrete_loss as D
from ballgraph.operators import loss as O
from ballgraph.operators import triangles as R
from ballgraph.operators.knn import complete_lists, neighbour_lists
from ballgraph.plans.catalog import (
    Tables, query, rounded, sql_draw, sql_rounded as r_, sql_uniform,
)
from ballgraph.plans.catalog_graph import KNN, SQL_KNN, knn, low_layout
from ballgraph.plans.embed import fit
from ballgraph.session import Scratch

SEED, EPOCH = 7, 1
PER_EDGE = 2
BETA = 10.0
SQL_EPS = "1e-9"


def sql_radius(a: str, b: str, c: str) -> str:
    """Smallest-ball radius as SQL text, soft maximum."""
    z = f"greatest({a}, {b}, {c})"
    x = f"least({a}, {b}, {c})"
    y = f"list_sort([{a}, {b}, {c}])[2]"
    s = f"(({a} + {b} + {c}) / 2)"
    top = f"({z} + ln(exp({BETA} * ({x} - {z})) + exp({BETA} * ({y} - {z})) + 1) / {BETA})"
    area = f"sqrt(greatest({s} * ({s} - {x}) * ({s} - {y}) * ({s} - {z}), 1e-9))"
    return (f"(CASE WHEN {z} * {z} >= {x} * {x} + {y} * {y} - 1e-9 THEN {top} / 2 "
            f"ELSE {x} * {y} * {z} / (4 * {area}) END)")


LINE_SIDES = {"a": "l_quantity", "b": "l_extendedprice / 1000.0", "c": "l_tax * 100.0"}


@query("q_triangle_radius", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, {", ".join(f"{e} AS {n}" for n, e in LINE_SIDES.items())} FROM lineitem)
SELECT l_orderkey, l_linenumber, {r_(sql_radius("a", "b", "c"))} AS soft,
  {r_("CASE WHEN greatest(a, b, c) ^ 2 >= least(a, b, c) ^ 2 + list_sort([a, b, c])[2] ^ 2 - 1e-9 THEN greatest(a, b, c) / 2 ELSE " + sql_radius("a", "b", "c") + " END")} AS hard
FROM s""")
def _triangle_radius(t):
    sides = t["lineitem"].select(
        "l_orderkey", "l_linenumber", *[F.expr(e).alias(n) for n, e in LINE_SIDES.items()]
    )
    return sides.select(
        "l_orderkey", "l_linenumber",
        rounded(F.expr(kernels.ball_radius("a", "b", "c", soft=True, beta=BETA))).alias("soft"),
        rounded(F.expr(kernels.ball_radius("a", "b", "c", soft=False))).alias("hard"),
    )


SQL_CAND = """lists AS (SELECT i, list(j ORDER BY rank) AS js FROM knn GROUP BY i),
  cand AS (SELECT a.i, a.j, list_filter(list_concat(a.js, b.js), lambda x: x <> a.i AND x <> a.j) AS ks
    FROM (SELECT i, js, unnest(js) AS j FROM lists) a JOIN lists b ON a.j = b.i)"""


def lists(t: Tables):
    return neighbour_lists(knn(t))


@query("q_candidate_triangles", f"""WITH {SQL_KNN}, {SQL_CAND}
SELECT i, j, (generate_subscripts(ks, 1) - 1)::BIGINT AS pos, unnest(ks) AS k FROM cand""")
def _candidates(t):
    rows = C.candidate_triangles(lists(t)).select("i", "j", F.posexplode("ks").alias("pos", "k"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


SQL_POS = f"""{SQL_CAND},
  pos AS (SELECT i, j, ks[(1 + {sql_draw(str(SEED), str(EPOCH), "'pos'", "i", "j", "rep")} % len(ks))::INT] AS k, rep
    FROM cand, (SELECT unnest(range({PER_EDGE}))::INT AS rep))"""


def positives(t: Tables, near=None):
    cand = C.candidate_triangles(near if near is not None else lists(t))
    return R.positive_triplets(cand, t.points().count(), PER_EDGE, SEED, EPOCH, hasher="md5")


@query("q_pos_triplets", f"WITH {SQL_KNN}, {SQL_POS} SELECT i, j, k, rep FROM pos")
def _pos(t):
    return positives(t)


def sql_first_ok(what: str, ok, fallback) -> str:
    drawn = [f"({sql_draw(str(SEED), str(EPOCH), f'{chr(39)}{what}{chr(39)}', str(r), 'slot')} % n)"
             for r in range(R.REDRAWS)]
    tries = ", ".join(f"CASE WHEN {ok(x)} THEN {x} END" for x in drawn)
    return f"coalesce({tries}, {fallback(f'(({drawn[-1]} + 1) % n)')})"


def sql_after(x: str) -> str:
    tries = [f"(({x} + {step}) % n)" for step in range(3)]
    return "coalesce(" + ", ".join(
        f"CASE WHEN {c} <> i AND {c} <> j THEN {c} END" for c in tries[:2]) + f", {tries[2]})"


def sql_negatives(n_uniform: str, n_local: str, exclude: bool = False) -> str:
    """CTE ``neg`` (slot, i, j, k) after ``lists``."""
    free = lambda x: f"{x} <> i AND NOT list_contains(js, {x})"
    fits = lambda x: f"{x} <> i AND {x} <> j"
    if exclude:
        fits = lambda x: f"{x} <> i AND {x} <> j AND NOT list_contains(js, {x}) AND NOT list_contains(jj, {x})"
    rank = sql_draw(str(SEED), str(EPOCH), "'rank'", "0", "slot")
    return f"""nn AS (SELECT count(*) AS n FROM pts),
  slots AS (SELECT unnest(range({n_uniform} + {n_local})) AS slot),
  src AS (SELECT slot, {sql_draw(str(SEED), str(EPOCH), "'source'", "0", "slot")} % n AS i, n FROM slots, nn),
  sec AS (SELECT slot, n, src.i, js, CASE WHEN slot < {n_uniform}
      THEN {sql_first_ok("second", free, lambda x: x).replace(" i ", " src.i ")}
      ELSE js[(1 + {rank} % len(js))::INT] END AS j FROM src JOIN lists ON src.i = lists.i),
  thr AS (SELECT sec.*, l2.js AS jj FROM sec JOIN lists l2 ON sec.j = l2.i),
  neg AS (SELECT slot, i, j, {sql_first_ok("third", fits, sql_after)} AS k FROM thr)"""


SQL_RAGGED = """near AS (SELECT knn.* FROM knn JOIN pts ON knn.i = pts.id WHERE pts.label <> 9),
  short AS (SELECT i, list(j ORDER BY rank) AS js FROM near GROUP BY i),
  lists AS (SELECT id AS i, coalesce(js, []::BIGINT[]) AS js FROM pts LEFT JOIN short ON id = i),
  held AS (SELECT i, js, row_number() OVER (ORDER BY i) - 1 AS rank FROM short)"""


def sql_ragged_negatives(n_uniform: str, n_local: str, exclude: bool) -> str:
    """``sql_negatives`` with sources drawn among the points that have a list."""
    text = sql_negatives(n_uniform, n_local, exclude)
    source = f"{sql_draw(str(SEED), str(EPOCH), chr(39) + 'source' + chr(39), '0', 'slot')} % n AS i, n FROM slots, nn)"
    assert source in text and "JOIN lists ON src.i = lists.i)" in text
    text = text.replace(source, source.replace(
        "% n AS i, n FROM slots, nn)", "% (SELECT count(*) FROM held) AS at, n FROM slots, nn)"
    ))
    return text.replace("src.i, js,", "held.i, js,").replace(
        "JOIN lists ON src.i = lists.i)", "JOIN held ON src.at = held.rank)"
    ).replace(" src.i ", " held.i ")


SQL_N = "(SELECT count(*) FROM pts)"
SQL_HALF = f"round_even({SQL_N} * {KNN} * 0.5, 0)::BIGINT"


def negatives(t: Tables, uniform: bool, local: bool, exclude: bool = False, near=None):
    n = t.points().count()
    n_uniform, n_local = R.negative_counts(n * KNN, 1, 0.5)
    return R.negative_triplets(
        near if near is not None else lists(t), n, n_uniform * uniform, n_local * local, SEED, EPOCH,
        exclude, hasher="md5",
    )


@query("q_neg_uniform", f"WITH {SQL_KNN}, {SQL_CAND}, {sql_negatives(SQL_HALF, '0')} SELECT slot, i, j, k FROM neg")
def _neg_uniform(t):
    return negatives(t, True, False)


@query("q_neg_semilocal", f"WITH {SQL_KNN}, {SQL_CAND}, {sql_negatives('0', SQL_HALF)} SELECT slot, i, j, k FROM neg")
def _neg_local(t):
    return negatives(t, False, True)


@query("q_neg_excluded",
       f"WITH {SQL_KNN}, {SQL_CAND}, {sql_negatives(SQL_HALF, SQL_HALF, True)} SELECT slot, i, j, k FROM neg")
def _neg_excluded(t):
    return negatives(t, True, True, exclude=True)


def ragged(t: Tables):
    """Complete lists of a neighbour table in which the points of one label have no neighbours."""
    near = knn(t).join(t.points().where("label <> 9").selectExpr("id AS i"), "i")
    return complete_lists(neighbour_lists(near), t.points())


def _ragged_negatives(t: Tables, exclude: bool):
    n = t.points().count()
    ranked, n_sources = R.source_ranks(ragged(t), n, Scratch(t.spark, "query"))
    n_uniform, n_local = R.negative_counts(n * KNN, 1, 0.5)
    return R.negative_triplets(ranked, n, n_uniform, n_local, SEED, EPOCH, exclude, "md5", n_sources)


@query("q_neg_ragged",
       f"WITH {SQL_KNN}, {SQL_RAGGED}, {sql_ragged_negatives(SQL_HALF, SQL_HALF, False)} SELECT slot, i, j, k FROM neg")
def _neg_ragged(t):
    return _ragged_negatives(t, False)


@query("q_neg_ragged_excluded",
       f"WITH {SQL_KNN}, {SQL_RAGGED}, {sql_ragged_negatives(SQL_HALF, SQL_HALF, True)} SELECT slot, i, j, k FROM neg")
def _neg_ragged_excluded(t):
    return _ragged_negatives(t, True)


@query("q_pos_ragged", f"""WITH {SQL_KNN}, {SQL_RAGGED},
  cand AS (SELECT a.i, a.j, list_filter(list_concat(a.js, b.js), lambda x: x <> a.i AND x <> a.j) AS ks
    FROM (SELECT i, js, unnest(js) AS j FROM lists) a JOIN lists b ON a.j = b.i)
SELECT i, j, ks[(1 + {sql_draw(str(SEED), str(EPOCH), "'pos'", "i", "j", "rep")} % len(ks))::INT] AS k, rep
FROM cand, (SELECT unnest(range({PER_EDGE}))::INT AS rep)""")
def _pos_ragged(t):
    return positives(t, ragged(t))


def sql_gap(p: str, q: str, v: str = "v") -> str:
    return (f"sqrt(list_sum(list_transform(list_zip({p}.{v}, {q}.{v}), "
            f"lambda p: (p[1] - p[2]) * (p[1] - p[2]))))")


SQL_WEIGHTED = f"""{SQL_POS},
  maxd AS (SELECT max(d) AS md FROM knn),
  sd AS (SELECT pos.i, pos.j, pos.k, rep, {sql_gap("p", "q")} AS a, {sql_gap("p", "s")} AS b, {sql_gap("q", "s")} AS c
    FROM pos JOIN pts p ON pos.i = p.id JOIN pts q ON pos.j = q.id JOIN pts s ON pos.k = s.id),
  wpos AS (SELECT i, j, k, rep, exp(-4 * {sql_radius("a", "b", "c")} / greatest(md, 1e-9)) AS w FROM sd, maxd)"""


def max_distance(near) -> float:
    return near.agg(F.max("d")).first()[0]


def weighted(t: Tables):
    near = t.saved(knn(t))
    rows = positives(t, neighbour_lists(near))
    return C.triangle_weights(t.saved(rows), t.vectors(), None, max_distance(near), "euclidean", True, BETA)


@query("q_cech_weights", f"WITH {SQL_KNN}, {SQL_WEIGHTED} SELECT i, j, k, rep, {r_('w')} AS w FROM wpos")
def _cech_weights(t):
    return weighted(t).select("i", "j", "k", "rep", rounded("w").alias("w"))


@query("q_candidate_weights", f"""WITH {SQL_KNN}, {SQL_CAND},
  tri AS (SELECT i, j, (generate_subscripts(ks, 1) - 1)::BIGINT AS pos, unnest(ks) AS k FROM cand),
  sd AS (SELECT tri.*, {sql_gap("p", "q")} AS a, {sql_gap("p", "s")} AS b, {sql_gap("q", "s")} AS c
    FROM tri JOIN pts p ON tri.i = p.id JOIN pts q ON tri.j = q.id JOIN pts s ON tri.k = s.id)
SELECT i, j, pos, k, {r_("exp(-4 * " + sql_radius("a", "b", "c") + " / (SELECT max(d) FROM knn))")} AS w FROM sd""")
def _candidate_weights(t):
    near = t.saved(knn(t))
    packed = t.saved(C.packs(t.vectors(), neighbour_lists(near)))
    rows = C.weighted_candidates(packed, max_distance(near), True, BETA)
    flat = rows.select("i", "j", F.posexplode(F.arrays_zip("ks", "ws")).alias("pos", "z"))
    return flat.select("i", "j", F.col("pos").cast("bigint").alias("pos"),
                       F.col("z.ks").alias("k"), rounded("z.ws").alias("w"))


def sql_discrete(points: str, v: str, square_floor: str) -> str:
    """CTEs ending in ``disc`` (i, j, k, rep, r) for the triangles in ``pos``."""
    dist = lambda p: (f"sqrt(greatest(list_sum(list_transform(list_zip({p}.{v}, y.{v}), "
                      f"lambda p: (p[1] - p[2]) * (p[1] - p[2]))), {square_floor}))")
    return f"""cen AS (SELECT pos.i, pos.j, pos.k, rep, unnest(list_concat(a.js, b.js, c.js)) AS c
    FROM pos JOIN lists a ON pos.i = a.i JOIN lists b ON pos.j = b.i JOIN lists c ON pos.k = c.i),
  far AS (SELECT cen.i, cen.j, cen.k, rep, list_sort([{dist("p")}, {dist("q")}, {dist("s")}]) AS ds
    FROM cen JOIN {points} p ON cen.i = p.id JOIN {points} q ON cen.j = q.id
      JOIN {points} s ON cen.k = s.id JOIN {points} y ON cen.c = y.id),
  mx AS (SELECT i, j, k, rep, ds[3] + ln(exp({BETA} * (ds[1] - ds[3])) + exp({BETA} * (ds[2] - ds[3])) + 1) / {BETA} AS m
    FROM far),
  disc AS (SELECT i, j, k, rep, lo - ln(s) / {BETA} AS r FROM (
    SELECT i, j, k, rep, any_value(lo) AS lo, sum(exp(-{BETA} * (m - lo))) AS s
    FROM (SELECT *, min(m) OVER (PARTITION BY i, j, k, rep) AS lo FROM mx) GROUP BY i, j, k, rep))"""


SQL_BAG = "pos AS (SELECT i, j, (generate_subscripts(ks, 1) - 1)::BIGINT AS rep, unnest(ks) AS k FROM cand)"


@query("q_candidate_weights_discrete", f"""WITH {SQL_KNN}, {SQL_CAND}, {SQL_BAG}, {sql_discrete("pts", "v", "1e-12")}
SELECT i, j, rep AS pos, k, {r_("exp(-2 * r / (SELECT max(d) FROM knn))")} AS w FROM disc""")
def _candidate_weights_discrete(t):
    near = t.saved(knn(t))
    packed = t.saved(C.packs(t.vectors(), neighbour_lists(near)))
    rows = C.weighted_candidates_discrete(packed, max_distance(near), BETA)
    flat = rows.select("i", "j", F.posexplode(F.arrays_zip("ks", "ws")).alias("pos", "z"))
    return flat.select("i", "j", F.col("pos").cast("bigint").alias("pos"),
                       F.col("z.ks").alias("k"), rounded("z.ws").alias("w"))


@query("q_cech_discrete", f"""WITH {SQL_KNN}, {SQL_POS}, {sql_discrete("pts", "v", "1e-12")}
SELECT i, j, k, rep, {r_("r")} AS r FROM disc""")
def _cech_discrete(t):
    near = t.saved(lists(t))
    rows = C.discrete_radii(positives(t, near), t.saved(C.packs(t.vectors(), near)), BETA)
    return rows.select("i", "j", "k", "rep", rounded("r").alias("r"))


SQL_EMB = "emb AS (SELECT id, v[1] AS y0, v[2] AS y1 FROM pts)"

SQL_TRIANGLES = f"""{SQL_WEIGHTED}, {sql_negatives(SQL_HALF, SQL_HALF)},
  {SQL_EMB},
  tri AS (SELECT i, j, k, w, TRUE AS positive FROM wpos UNION ALL SELECT i, j, k, 1.0, FALSE FROM neg),
  pl AS (SELECT tri.*, p.y0 AS i0, p.y1 AS i1, q.y0 AS j0, q.y1 AS j1, s.y0 AS k0, s.y1 AS k1,
      sqrt((p.y0 - q.y0) ^ 2 + (p.y1 - q.y1) ^ 2) AS a, sqrt((p.y0 - s.y0) ^ 2 + (p.y1 - s.y1) ^ 2) AS b,
      sqrt((q.y0 - s.y0) ^ 2 + (q.y1 - s.y1) ^ 2) AS c
    FROM tri JOIN emb p ON tri.i = p.id JOIN emb q ON tri.j = q.id JOIN emb s ON tri.k = s.id),
  rad AS (SELECT *, 2 * {sql_radius("a", "b", "c")} AS r FROM pl),
  ls AS (SELECT *, {SQL_N} * {KNN * PER_EDGE} AS np, CASE WHEN positive THEN w * -ln(greatest(1 / (1 + r * r), 1e-6))
      ELSE -ln(greatest(1 - 1 / (1 + r * r), 1e-6)) END AS loss FROM rad)"""


def losses(t: Tables):
    near = t.saved(lists(t))
    neg = negatives(t, True, True, near=near).select("i", "j", "k", F.lit(1.0).alias("w"))
    pos = weighted(t).select("i", "j", "k", "w")
    rows = pos.withColumn("positive", F.lit(True)).unionByName(neg.withColumn("positive", F.lit(False)))
    n = t.points().count()
    placed = O.place(rows, O.widen(low_layout(t), 2), 2, O.fits_broadcast(n, 2))
    return O.triangle_losses(placed, beta=BETA), n * KNN * PER_EDGE


@query("q_ce_loss", f"WITH {SQL_KNN}, {SQL_TRIANGLES} SELECT {r_('sum(loss) / any_value(np)')} AS loss FROM ls")
def _ce_loss(t):
    rows, n_positive = losses(t)
    return O.mean_loss(rows, n_positive).select(rounded("loss").alias("loss"))


SQL_AREA = "((a + b + c) / 2 * ((a + b + c) / 2 - a) * ((a + b + c) / 2 - b) * ((a + b + c) / 2 - c))"


def sql_slope(m: str, p: str, q: str) -> str:
    """dR/dside for side m, as SQL text."""
    z = "greatest(a, b, c)"
    wide = f"exp({BETA} * ({m} - {z})) / (exp({BETA} * (a - {z})) + exp({BETA} * (b - {z})) + exp({BETA} * (c - {z}))) / 2"
    bend = f"CASE WHEN {SQL_AREA} > 1e-9 THEN {m} * ({p} * {p} + {q} * {q} - {m} * {m}) / (8 * {SQL_AREA}) ELSE 0 END"
    middle = "list_sort([a, b, c])[2]"
    obtuse = f"{z} * {z} >= least(a, b, c) ^ 2 + {middle} * {middle} - 1e-9"
    return f"CASE WHEN {obtuse} THEN {wide} ELSE r / 2 * (1 / {m} - ({bend})) END"


SQL_PULL = """(CASE WHEN positive THEN CASE WHEN 1 / (1 + r * r) >= 1e-6 THEN w * 2 * r / (1 + r * r) ELSE 0 END
    ELSE CASE WHEN 1 - 1 / (1 + r * r) >= 1e-6 THEN -2 / (r * (1 + r * r)) ELSE 0 END END)"""

SQL_GRADIENT = f"""{SQL_TRIANGLES},
  fr AS (SELECT *, CASE WHEN a > 0 THEN 2 * {SQL_PULL} * ({sql_slope("a", "b", "c")}) / a / np ELSE 0 END AS fa,
      CASE WHEN b > 0 THEN 2 * {SQL_PULL} * ({sql_slope("b", "a", "c")}) / b / np ELSE 0 END AS fb,
      CASE WHEN c > 0 THEN 2 * {SQL_PULL} * ({sql_slope("c", "a", "b")}) / c / np ELSE 0 END AS fc FROM ls),
  vg AS (
    SELECT i AS id, fa * (i0 - j0) + fb * (i0 - k0) AS g0, fa * (i1 - j1) + fb * (i1 - k1) AS g1 FROM fr
    UNION ALL SELECT j, fa * (j0 - i0) + fc * (j0 - k0), fa * (j1 - i1) + fc * (j1 - k1) FROM fr
    UNION ALL SELECT k, fb * (k0 - i0) + fc * (k0 - j0), fb * (k1 - i1) + fc * (k1 - j1) FROM fr),
  gr AS (SELECT id, sum(g0) AS g0, sum(g1) AS g1 FROM vg GROUP BY id)"""


def gradient(t: Tables):
    rows, n_positive = losses(t)
    return O.gradients(rows, 2, n_positive)


@query("q_gradient", f"WITH {SQL_KNN}, {SQL_GRADIENT} SELECT id, {r_('g0', 7)} AS g0, {r_('g1', 7)} AS g1 FROM gr")
def _gradient(t):
    return gradient(t).select("id", rounded("g0", 7).alias("g0"), rounded("g1", 7).alias("g1"))


def stepped(t: Tables, optimizer: str, step: int, **options):
    """One step from zero moments, counted as step number ``step``."""
    state = O.start_state(O.widen(low_layout(t), 2), 2, optimizer).withColumn("t", F.lit(step - 1))
    rows, n_positive = losses(t)
    new = O.step(state, O.gradient_rows(rows, 2, n_positive), 2, optimizer, 1.0, **options)
    return new.select("id", *[rounded(c, 5).alias(c) for c in ("y0", "y1")])


def sql_step(moved) -> str:
    cols = ", ".join(r_(f"coalesce({moved(f'y{c}', f'g{c}')}, y{c})", 5) + f" AS y{c}" for c in (0, 1))
    return f"WITH {SQL_KNN}, {SQL_GRADIENT} SELECT id, {cols} FROM emb LEFT JOIN gr USING (id)"


@query("q_sgd_step", sql_step(lambda y, g: f"{y} - {g}"))
def _sgd(t):
    return stepped(t, "sgd", 1)


@query("q_adagrad_step", sql_step(lambda y, g: f"{y} - 1 / (1 + 2 * 0.1) * {g} / (sqrt({g} * {g}) + 1e-10)"))
def _adagrad(t):
    return stepped(t, "adagrad", 3, lr_decay=0.1)


@query("q_adam_step", sql_step(
    lambda y, g: f"{y} - sqrt(1 - 0.999 ^ 3) / (1 - 0.9 ^ 3) * 0.1 * {g} / (sqrt(0.001 * {g} * {g}) + 1e-8)"))
def _adam(t):
    return stepped(t, "sparse_adam", 3)


@query("q_ce_loss_discrete", f"""WITH {SQL_KNN}, {SQL_WEIGHTED},
  emb AS (SELECT id, v[1:2] AS y FROM pts), {sql_discrete("emb", "y", "0")}
SELECT {r_(f"sum(w * -ln(greatest(1 / (1 + 4 * r * r), 1e-6))) / ({SQL_N} * {KNN * PER_EDGE})")} AS loss
FROM disc JOIN wpos USING (i, j, k, rep)""")
def _ce_loss_discrete(t):
    near, wide = t.saved(lists(t)), O.widen(low_layout(t), 2)
    n_positive = t.points().count() * KNN * PER_EDGE
    grads = D.discrete_gradient_rows(weighted(t), D.layout_packs(wide, near, 2), 2, n_positive, beta=BETA)
    return grads.agg(rounded(F.sum("loss")).alias("loss"))


@query("q_mean_edge", f"""WITH {SQL_KNN}, emb AS (SELECT id, v[1:2] AS v FROM pts)
SELECT {r_("avg(" + sql_gap("p", "q") + ")")} AS mean_edge
FROM knn JOIN emb p ON knn.i = p.id JOIN emb q ON knn.j = q.id""")
def _mean_edge(t):
    n = t.points().count()
    mean = O.mean_edge_length(
        knn(t).select("i", "j"), O.widen(low_layout(t), 2), 2, O.fits_broadcast(n, 2)
    )
    return mean.select(rounded("mean_edge").alias("mean_edge"))


SQL_START = "emb AS (SELECT id, " + ", ".join(
    f"{sql_uniform(str(SEED), chr(39) + 'init' + chr(39), str(c), 'id')} * 20.0 - 10.0 AS y{c}" for c in (0, 1)
) + " FROM pts)"


@query("q_fit_epoch", sql_step(lambda y, g: f"{y} - 1000.0 * {g}").replace(SQL_EMB, SQL_START))
def _fit_epoch(t):
    """The whole fit for one epoch: neighbours, start, samples, weights, gradient, step."""
    out = fit(
        t.vectors(), n_neighbors=KNN, init="random", n_epochs=1, random_state=SEED, hasher="md5",
        triplets_per_edge=PER_EDGE, negative_rate_triplets=1 / PER_EDGE, optimizer="sgd", learning_rate=1000.0,
    )
    return out.embedding.select("id", *[rounded(F.get("y", F.lit(c)), 5).alias(f"y{c}") for c in (0, 1)])


@query("q_embed")
def _embed(t):
    return fit(t.vectors()).embedding.select(
        "id", *[F.get("y", F.lit(c)).alias(f"y{c}") for c in (0, 1)]
    )


@query("q_fit_log")
def _fit_log(t):
    return fit(t.vectors()).log
