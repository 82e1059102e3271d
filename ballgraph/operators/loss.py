"""Cross-entropy of triangle radii, its gradient per vertex, and the optimiser steps.

Layouts are wide here: ``(id, y0, y1, ...)``, so that every expression is generated code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions import kernels
from ballgraph.functions.draws import number

BROADCAST_BYTES = 64 << 20
SEND_ROWS = 65_536  # rows of a task's sums in one batch


def coords(n_components: int, prefix: str = "y") -> list[str]:
    return [f"{prefix}{c}" for c in range(n_components)]


def widen(layout: DataFrame, n_components: int) -> DataFrame:
    return layout.select("id", *[F.get("y", F.lit(c)).alias(f"y{c}") for c in range(n_components)])


def narrow(wide: DataFrame, n_components: int) -> DataFrame:
    return wide.select("id", F.array(*coords(n_components)).alias("y"))


def fits_broadcast(n_points: int, n_components: int) -> bool:
    return n_points * (n_components + 2) * 8 <= BROADCAST_BYTES


def place(triplets: DataFrame, wide: DataFrame, n_components: int, small: bool) -> DataFrame:
    """Joins the coordinates of the three corners and adds the side lengths a, b, c."""
    ys = coords(n_components)
    for corner in "ijk":
        at = wide.selectExpr(f"id AS {corner}", *[f"{y} AS {corner}_{y}" for y in ys])
        triplets = triplets.join(F.broadcast(at) if small else at, corner)
    side = lambda p, q: "sqrt(" + " + ".join(f"({p}_{y} - {q}_{y}) * ({p}_{y} - {q}_{y})" for y in ys) + ")"
    return triplets.selectExpr(
        "*", f"{side('i', 'j')} AS a", f"{side('i', 'k')} AS b", f"{side('j', 'k')} AS c"
    )


def layout_array(wide: DataFrame, n_points: int, n_components: int) -> np.ndarray:
    """A layout below ``BROADCAST_BYTES`` as an array whose rows follow the ids 0 to n - 1."""
    held = wide.select("id", *coords(n_components)).toArrow()
    out = np.empty((n_points, n_components))
    for c, y in enumerate(coords(n_components)):
        out[held.column("id").to_numpy(), c] = held.column(y).to_numpy()
    return out


def summed_pulls(
    triplets: DataFrame, layout, n_components: int, n_positive: int, alpha: float = 1.0, phi: str = "student",
    tau: float = 1.0, gamma: float = 1.0, soft: bool = True, beta: float = 10.0,
) -> DataFrame:
    """(id, g0.., loss) of triangles (i, j, k, w, positive): ``gradient_rows`` summed by task.

    ``layout`` is a broadcast variable with the array of ``layout_array``; a task holds it and a sum of its size.
    """
    gs, per = coords(n_components, "g"), 1.0 / max(n_positive, 1)
    names = ["id", *gs, "loss"]

    def run(batches):
        ys = [np.ascontiguousarray(x) for x in layout.value.T]  # a column each, as columns are gathered and added faster
        total, touched = np.zeros((n_components + 1, len(layout.value))), np.zeros(len(layout.value), dtype=bool)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("w")))
            if not batch.num_rows:
                continue
            at = [batch.column(c).to_numpy() for c in "ijk"]
            gaps = []  # of the sides, by column
            for y in ys:
                i, j, k = [y[c] for c in at]
                gaps.append((i - j, i - k, j - k))
            sides = [np.sqrt(sum(x * x for x in side)) for side in zip(*gaps)]
            radius, slopes = kernels.ball_arrays(*sides, soft, beta)
            w, positive = batch.column("w").to_numpy(), batch.column("positive").to_numpy(zero_copy_only=False)
            losses, pull = kernels.loss_arrays(2.0 * radius, positive, w, gamma, phi, tau)
            fa, fb, fc = [
                np.where(s > 0, 2.0 * pull * (alpha * per) * r / np.where(s > 0, s, 1.0), 0.0) for s, r in zip(sides, slopes)
            ]
            for c, (ab, ac, bc) in enumerate(gaps):
                ab, ac, bc = fa * ab, fb * ac, fc * bc
                for corner, x in zip(at, (ab + ac, bc - ab, -ac - bc)):
                    np.add.at(total[c], corner, x)
            np.add.at(total[-1], at[0], losses * per)
            for corner in at:
                touched[corner] = True
        found = np.flatnonzero(touched)
        for s in range(0, len(found), SEND_ROWS):
            part = found[s:s + SEND_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(x[part]) for x in total)], names)

    return triplets.select("i", "j", "k", "w", "positive").mapInArrow(
        run, "id bigint, " + ", ".join(f"{c} double" for c in names[1:])
    )


def triangle_losses(
    placed: DataFrame, phi: str = "student", tau: float = 1.0, gamma: float = 1.0,
    soft: bool = True, beta: float = 10.0,
) -> DataFrame:
    """Adds (r, loss, pull, ra, rb, rc): the diameter r = 2R, the weighted loss, its derivative by R
    and those of R by the sides.

    Rows are (positive BOOLEAN, w); a negative row's loss is gamma * w * repulsion.
    """
    rows = kernels.with_ball(placed, soft, beta).selectExpr("*", "2D * R_ AS r")
    (near, near_slope), (away, away_slope) = kernels.attract("r", phi, tau), kernels.repel("r", phi, tau)
    push = f"{number(gamma)} * w"
    return rows.selectExpr(
        "*", f"CASE WHEN positive THEN w * {near} ELSE {push} * {away} END AS loss",
        f"2D * CASE WHEN positive THEN w * {near_slope} ELSE {push} * {away_slope} END AS pull",
    )


def mean_loss(losses: DataFrame, n_positive: int) -> DataFrame:
    """One row: total loss over the number of positives."""
    return losses.agg((F.sum("loss") / F.lit(float(max(n_positive, 1)))).alias("loss"))


def gradient_rows(
    losses: DataFrame, n_components: int, n_positive: int, alpha: float = 1.0
) -> DataFrame:
    """(id, g0.., loss), three rows per triangle: closed-form derivatives by its corners.

    ``loss`` books each triangle's loss with its first corner, so one pass yields both.
    """
    scale = number(float(alpha) / max(n_positive, 1))
    rows = losses.selectExpr(
        *[f"{c}_{y}" for c in "ijk" for y in coords(n_components)], "i", "j", "k", *_forces(n_positive, scale)
    )
    return rows.selectExpr(f"inline(array({', '.join(f'struct({x})' for x in _corner_pulls(n_components))}))")


def _forces(n_positive: int, scale: str) -> list[str]:
    """The share of a triangle's loss, and its pull along the sides per unit of length."""
    return [
        f"loss / {number(max(n_positive, 1))} AS share",
        *[f"CASE WHEN {s} > 0 THEN pull * {scale} * r{s} / {s} ELSE 0D END AS f{s}" for s in "abc"],
    ]


def _corner_pulls(n_components: int) -> list[str]:
    """id, g0.., loss of the corners of a triangle."""
    def push(me: str, first: str, second: str, loss: str) -> str:
        (f1, p), (f2, q) = first, second
        parts = [
            f"f{f1} * ({me}_{y} - {p}_{y}) + f{f2} * ({me}_{y} - {q}_{y}) AS g{n}"
            for n, y in enumerate(coords(n_components))
        ]
        return f"{me} AS id, {', '.join(parts)}, {loss} AS loss"

    return [push("i", "aj", "bk", "share"), push("j", "ai", "ck", "0D"), push("k", "bi", "cj", "0D")]


def gradients(losses: DataFrame, n_components: int, n_positive: int, alpha: float = 1.0) -> DataFrame:
    """(id, g0.., loss) per touched vertex, summed with one shuffle."""
    return sum_gradients(gradient_rows(losses, n_components, n_positive, alpha), n_components)


def sum_gradients(rows: DataFrame, n_components: int) -> DataFrame:
    return rows.groupBy("id").agg(
        *[F.sum(g).alias(g) for g in coords(n_components, "g")], F.sum("loss").alias("loss")
    )


# Fixed values of the update rules.
ADAM_BETA1, ADAM_BETA2, ADAM_EPS = 0.9, 0.999, 1e-8
ADAGRAD_EPS = 1e-10

OPTIMIZERS = ("sparse_adam", "adagrad", "sgd")


def start_state(wide: DataFrame, n_components: int, optimizer: str) -> DataFrame:
    """Adds the step number and the zero moments an optimiser needs."""
    kinds = {"sparse_adam": ["m", "s"], "adagrad": ["s"], "sgd": []}
    if optimizer not in kinds:
        raise ValueError(f"unknown optimizer {optimizer!r}; use one of {OPTIMIZERS}")
    zeros = [f"0D AS {c}" for p in kinds[optimizer] for c in coords(n_components, p)]
    return wide.selectExpr("*", "0L AS t", *zeros)


def clipped(grads: DataFrame, n_components: int, max_norm: float) -> DataFrame:
    """Scales all gradients so that their joint length is at most ``max_norm``."""
    gs = coords(n_components, "g")
    length = grads.selectExpr(f"sqrt(sum({' + '.join(f'{g} * {g}' for g in gs)})) AS len").scalar()
    scale = F.least(F.lit(1.0), F.lit(float(max_norm)) / (length + F.lit(1e-6)))
    return grads.withColumns({g: F.col(g) * scale for g in gs})


def step(
    state: DataFrame, rows: DataFrame, n_components: int, optimizer: str,
    learning_rate: float = 1.0, lr_decay: float = 0.0, by_task: bool = False,
) -> DataFrame:
    """One update from gradient rows (id, g.., loss), summed or not; those summed ``by_task`` are only summed again after
    their shuffle.

    State and gradient rows meet in one grouped sum, so a step is a single shuffle without a join.
    Vertices without a gradient keep their position and moments. ``t`` in the state counts the steps
    made, so the text of a step is the same in every epoch; ``loss`` is the share booked with a vertex.
    """
    if optimizer not in OPTIMIZERS:
        raise ValueError(f"unknown optimizer {optimizer!r}; use one of {OPTIMIZERS}")
    gs = coords(n_components, "g")
    held = [c for c in state.columns if c not in ("id", "loss")]
    mine = state.selectExpr("id", *held, *[f"CAST(NULL AS double) AS {g}" for g in gs], "0D AS loss")
    pulls = rows.selectExpr(
        "id", *[f"CAST(NULL AS {'bigint' if c == 't' else 'double'}) AS {c}" for c in held], *gs, "loss"
    )
    met = mine.union(pulls)
    joined = (met.repartition("id") if by_task else met).groupBy("id").agg(
        *[F.max(c).alias(c) for c in held], *[F.sum(g).alias(g) for g in gs], F.sum("loss").alias("loss")
    )
    return joined.selectExpr(*_moved(held, n_components, optimizer, learning_rate, lr_decay))


def _moved(held: list[str], n_components: int, optimizer: str, learning_rate: float, lr_decay: float) -> list[str]:
    """The state's columns after a step, from the state's columns and the summed gradient."""
    rate, out = number(learning_rate), {}
    for c in range(n_components):
        y, g, m, s = f"y{c}", f"g{c}", f"m{c}", f"s{c}"
        if optimizer == "sgd":
            out[y] = f"{y} - {rate} * {g}"
        elif optimizer == "adagrad":
            out[s] = f"{s} + {g} * {g}"
            decayed = f"{rate} / (1D + t * {number(lr_decay)})"
            out[y] = f"{y} - {decayed} * {g} / (sqrt({out[s]}) + {number(ADAGRAD_EPS)})"
        else:
            b1, b2 = number(ADAM_BETA1), number(ADAM_BETA2)
            out[m] = f"({m} + (1D - {b1}) * ({g} - {m}))"
            out[s] = f"({s} + (1D - {b2}) * ({g} * {g} - {s}))"
            size = f"{rate} * sqrt(1D - power({b2}, t + 1)) / (1D - power({b1}, t + 1))"
            out[y] = f"{y} - {size} * {out[m]} / (sqrt({out[s]}) + {number(ADAM_EPS)})"
    moved = [f"CASE WHEN g0 IS NOT NULL THEN {out[c]} ELSE {c} END AS {c}" for c in held if c != "t"]
    return ["id", "t + 1 AS t", *moved, "loss"]


class Steps:
    """A query that grows by nesting, each part read once; Spark parses and analyses it in one go.

    It has the ``selectExpr`` of a DataFrame, so the functions above build it as they build a DataFrame.
    """

    def __init__(self, source: str):
        self.source = source

    def then(self, sql: str) -> "Steps":
        """``sql`` reads what there is so far as {here}."""
        return Steps(f"({sql.replace('{here}', self.source)})")

    def selectExpr(self, *columns: str) -> "Steps":
        return self.then(f"SELECT {', '.join(columns)} FROM {{here}}")

    def text(self) -> str:
        return self.source.removeprefix("(").removesuffix(")")


#: What marks the row that carries a vertex's own state among the corners of triangles.
OWN = -1


_CORNERS = "array(struct(i AS id, 0 AS c), struct(j AS id, 1 AS c), struct(k AS id, 2 AS c))"
_CORNER_ROW = f"inline(CASE WHEN s = {OWN} THEN array(struct(i AS id, 0 AS c)) ELSE {_CORNERS} END)"


def with_own_rows(triplets: DataFrame, vertices: DataFrame, epochs: tuple[int, int]) -> DataFrame:
    """Triangles (epoch, s, i, j, k, w, positive) and one row in each epoch for each vertex itself."""
    own = vertices.selectExpr(
        f"explode(sequence({epochs[0]}, {epochs[1]})) AS epoch", f"{OWN}L AS s", "id AS i",
        "CAST(NULL AS bigint) AS j", "CAST(NULL AS bigint) AS k", "CAST(NULL AS double) AS w", "false AS positive",
    )
    return triplets.unionByName(own)


def by_corner(rows: DataFrame) -> DataFrame:
    """The rows of ``with_own_rows`` by the vertices they meet: (id, c) is a row's corner, 0 for a vertex itself."""
    return rows.selectExpr("epoch", "s", "i", "j", "k", "w", "positive", _CORNER_ROW)


def chained_step(
    state: Steps, held: list[str], corners: str, epoch: int, n_components: int, n_positive: int, optimizer: str,
    learning_rate: float, lr_decay: float, alpha: float, phi: str, tau: float, gamma: float, soft: bool, beta: float,
    small: bool,
) -> Steps:
    """One epoch as a query on the state before it, which it reads once; so several epochs make one job.

    Corners of the written table meet the state of their vertex, triangles gather their three corners, and gradients and
    states are summed by vertex. A ``small`` state is broadcast, and the corners of triangles bucketed by their first
    vertex meet where they lie: one shuffle, of the sums. Else corners are bucketed by vertex like the state, meet it
    without a shuffle and move once to their triangle. ``held`` are the state's columns but for id and loss.
    """
    corner = f"SELECT s, i, j, k, w, positive, {_CORNER_ROW if small else 'id, c'} FROM {corners} WHERE epoch = {epoch}"
    ys, gs = coords(n_components), coords(n_components, "g")
    met = state.then(
        f"SELECT {'/*+ BROADCAST(held) */ ' if small else ''}c, s, i, j, k, w, positive, {', '.join(held)} "
        f"FROM {{here}} AS held JOIN ({corner}) USING (id)"
    )
    key = "s, i, j, k, w, positive"
    at = [f"max(CASE WHEN c = {n} THEN {y} END) AS {corner}_{y}" for n, corner in enumerate("ijk") for y in ys]
    own = [f"max(CASE WHEN s = {OWN} THEN {h} END) AS {h}" for h in held]
    rows = met.then(f"SELECT {key}, {', '.join(at + own)} FROM {{here}} GROUP BY {key}")
    side = lambda p, q: "sqrt(" + " + ".join(f"({p}_{y} - {q}_{y}) * ({p}_{y} - {q}_{y})" for y in ys) + ")"
    rows = rows.selectExpr("*", f"{side('i', 'j')} AS a", f"{side('i', 'k')} AS b", f"{side('j', 'k')} AS c")
    rows = triangle_losses(rows, phi, tau, gamma, soft, beta)
    rows = rows.selectExpr(
        "s", "i", "j", "k", *held, *[f"{c}_{y}" for c in "ijk" for y in ys],
        *_forces(n_positive, number(float(alpha) / max(n_positive, 1))),
    )
    none = [f"CAST(NULL AS {'bigint' if h == 't' else 'double'}) AS {h}" for h in held]
    pulls = [f"struct({x}, {', '.join(none)})" for x in _corner_pulls(n_components)]
    carried = ", ".join([*(f"CAST(NULL AS double) AS {g}" for g in gs), "0D AS loss", *held])
    rows = rows.selectExpr(f"inline(CASE WHEN s = {OWN} THEN array(struct(i AS id, {carried})) ELSE array({', '.join(pulls)}) END)")
    sums = [f"max({h}) AS {h}" for h in held] + [f"sum({g}) AS {g}" for g in (*gs, "loss")]
    rows = rows.then(f"SELECT id, {', '.join(sums)} FROM {{here}} GROUP BY id")
    return rows.selectExpr(*_moved(held, n_components, optimizer, learning_rate, lr_decay))


def mean_edge_length(edges: DataFrame, wide: DataFrame, n_components: int, small: bool) -> DataFrame:
    """One row: mean layout length of the neighbour edges."""
    for corner in "ij":
        at = wide.select(
            F.col("id").alias(corner), *[F.col(y).alias(f"{corner}_{y}") for y in coords(n_components)]
        )
        edges = edges.join(F.broadcast(at) if small else at, corner)
    gaps = [F.col(f"i_{y}") - F.col(f"j_{y}") for y in coords(n_components)]
    return edges.agg(F.avg(F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))).alias("mean_edge"))
