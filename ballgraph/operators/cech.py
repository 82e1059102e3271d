"""Triangles over neighbour lists and the radius of the ball that covers them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions.arrow import add_columns, list_array
from ballgraph.functions.kernels import AREA_FLOOR, RIGHT_SLACK
from ballgraph.functions.vectors import list_matrix, list_offsets

# Fixed values of the discrete radius and the weights.
SQUARE_FLOOR = 1e-12
REACH_FLOOR = 1e-9
STEP_ENTRIES = 1 << 18   # entries of centres measured at a time
HELD_BYTES = 64 << 20    # points and lists up to this size go to the tasks,
STEP_TRIANGLES = 1 << 14  # where so many triangles are measured at a time


def ball_radius_rows(a: np.ndarray, b: np.ndarray, c: np.ndarray, soft: bool, beta: float) -> np.ndarray:
    """``kernels.ball_radius`` for arrays inside a task."""
    x, y, z = np.sort(np.stack([a, b, c]), axis=0)
    s = (x + y + z) / 2.0
    area = np.sqrt(np.maximum(s * (s - x) * (s - y) * (s - z), AREA_FLOOR))
    top = z + np.log(np.exp(beta * (x - z)) + np.exp(beta * (y - z)) + 1.0) / beta if soft else z
    return np.where(z * z >= x * x + y * y - RIGHT_SLACK, top / 2.0, x * y * z / (4.0 * area))


def candidate_triangles(lists: DataFrame) -> DataFrame:
    """(i, j, ks) per neighbour edge: the bag N(i) + N(j) without i and j. Copies count twice."""
    edges = lists.select("i", F.col("js").alias("mine"), F.explode("js").alias("j"))
    other = lists.select(F.col("i").alias("j"), F.col("js").alias("theirs"))
    bag = F.concat("mine", "theirs")
    return edges.join(other, "j").select(
        "i", "j", F.array_remove(F.array_remove(bag, F.col("i")), F.col("j")).alias("ks")
    )


def packs(points: DataFrame, lists: DataFrame) -> DataFrame:
    """(i, v, js, nv): every point with its neighbours' vectors, flattened in rank order."""
    near = lists.select("i", F.posexplode("js").alias("pos", "j"))
    vecs = points.select(F.col("id").alias("j"), F.col("v").alias("w"))
    lined = near.join(vecs, "j").groupBy("i").agg(
        F.array_sort(F.collect_list(F.struct("pos", "j", "w"))).alias("l")
    ).select("i", F.col("l.j").alias("js"), F.flatten("l.w").alias("nv"))
    return points.select(F.col("id").alias("i"), "v").join(lined, "i", "left").select(
        "i", "v", F.expr("coalesce(js, cast(array() as array<bigint>))").alias("js"),
        F.expr("coalesce(nv, cast(array() as array<double>))").alias("nv"),
    )


def _rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def weighted_candidates(
    packed: DataFrame, max_d: float, soft: bool = True, beta: float = 10.0
) -> DataFrame:
    """(i, j, ks, ws): the candidates of every edge and the weight of each triangle.

    The neighbour vectors of j travel once per edge and meet those of i by one join, in single precision if they
    have no other; an epoch then only picks from the short lists.
    """
    reach = max(float(max_d), REACH_FLOOR)
    if _single(packed):
        packed = packed.withColumns({c: F.col(c).cast("array<float>") for c in ("v", "nv")})
    mine = packed.select("i", F.col("v").alias("vi"), F.col("js").alias("ni"), F.col("nv").alias("mi"))
    theirs = packed.select(
        F.col("i").alias("j"), F.col("v").alias("vj"), F.col("js").alias("nj"), F.col("nv").alias("mj")
    )
    edges = packed.select("i", F.explode("js").alias("j"))
    rows = edges.join(theirs, "j").join(mine, "i")

    def weigh(batch):
        i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
        vi, vj = list_matrix(batch.column("vi")), list_matrix(batch.column("vj"))
        row, third, vk = [], [], []
        for ids, vecs in (("ni", "mi"), ("nj", "mj")):
            row.append(_rows_of(list_offsets(batch.column(ids))))
            third.append(batch.column(ids).flatten().to_numpy())
            flat = batch.column(vecs).flatten().to_numpy().astype(np.float64, copy=False)
            vk.append(flat.reshape(len(third[-1]), vi.shape[1]))
        order = np.argsort(np.concatenate(row), kind="stable")  # N(i) before N(j) in every row
        row = np.concatenate(row)[order]
        third, vk = np.concatenate(third)[order], np.concatenate(vk)[order]
        real = (third != i[row]) & (third != j[row])
        row, third, vk = row[real], third[real], vk[real]
        side = _length(vi, vj)
        r = ball_radius_rows(side[row], _length(vi[row], vk), _length(vj[row], vk), soft, beta)
        w = np.exp(-2.0 * (2.0 * r) / reach)
        sizes = np.bincount(row, minlength=len(i))
        return {"ks": list_array(third, sizes), "ws": list_array(w, sizes)}

    return add_columns(
        rows, ["vi", "ni", "mi", "vj", "nj", "mj"], weigh,
        {"ks": "array<bigint>", "ws": "array<double>"},
    )


def _with_corners(triplets: DataFrame, side: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Joins per-point columns to all three corners, as <name>_i, <name>_j, <name>_k."""
    for corner in "ijk":
        one = side.select(
            F.col("i").alias(corner), *[F.col(src).alias(f"{name}_{corner}") for name, src in cols.items()]
        )
        triplets = triplets.join(one, corner)
    return triplets


def euclidean_radii(triplets: DataFrame, points: DataFrame, soft: bool = True, beta: float = 10.0) -> DataFrame:
    """Adds ``r``, the smallest-ball radius of each (i, j, k)."""
    rows = _with_corners(triplets, points.withColumnRenamed("id", "i"), {"v": "v"})

    def radius(batch):
        vi, vj, vk = (list_matrix(batch.column(f"v_{c}")) for c in "ijk")
        return {"r": pa.array(ball_radius_rows(_length(vi, vj), _length(vi, vk), _length(vj, vk), soft, beta))}

    return add_columns(rows, ["v_i", "v_j", "v_k"], radius, {"r": "double"})


def soft_reach(d: np.ndarray, offsets: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft minimum over the centres of the soft maximum over the anchors.

    ``d`` is (3, centres) with the centres of row r at ``offsets[r]:offsets[r+1]``. Returns the radius
    per row and the soft maximum per centre.
    """
    top = d.max(axis=0)
    far = top + np.log(np.exp(beta * (d - top)).sum(axis=0)) / beta
    low = np.minimum.reduceat(far, offsets[:-1])
    row = _rows_of(offsets)
    near = np.add.reduceat(np.exp(-beta * (far - low[row])), offsets[:-1])
    return low - np.log(near) / beta, far


def _nearer_centres(batch, beta: float) -> dict:
    """The soft minimum over the centres so far, as (_lo, _sum), with those in ``_n``, the neighbours of one corner.

    ``_sum`` adds up exp(-beta (far - _lo)) over the centres, whose nearest has far = ``_lo``.
    """
    corner = {c: list_matrix(batch.column(f"_v{c}")) for c in "ijk"}
    lo, total = (batch.column(c).to_numpy().copy() for c in ("_lo", "_sum"))
    width = corner["i"].shape[1]
    offsets = list_offsets(batch.column("_n")) // width
    flat = batch.column("_n").flatten().to_numpy(zero_copy_only=False)
    start = 0
    while start < len(lo):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + STEP_ENTRIES // width, side="right")) - 1)
        sizes = np.diff(offsets[start:end + 1])
        some = start + np.flatnonzero(sizes)
        if len(some):
            row = np.repeat(np.arange(start, end), sizes)
            centre = flat[offsets[start] * width:offsets[end] * width].reshape(-1, width).astype(np.float64)
            square = np.stack([((v[row] - centre) ** 2).sum(axis=1) for v in corner.values()])
            d = np.sqrt(np.maximum(square, SQUARE_FLOOR))
            top = d.max(axis=0)
            far = top + np.log(np.exp(beta * (d - top)).sum(axis=0)) / beta
            first = offsets[some] - offsets[start]
            low = np.minimum(lo[some], np.minimum.reduceat(far, first))
            before = np.where(np.isfinite(lo[some]), total[some] * np.exp(-beta * (lo[some] - low)), 0.0)
            total[some] = before + np.add.reduceat(np.exp(-beta * (far - np.repeat(low, sizes[sizes > 0]))), first)
            lo[some] = low
        start = end
    return {"_lo": pa.array(lo), "_sum": pa.array(total)}


@dataclass
class _Held:
    """Points and neighbour lists as arrays: list r is ``near[first[r]:first[r + 1]]``, in rows of ``x``."""

    ids: np.ndarray
    x: np.ndarray
    first: np.ndarray
    near: np.ndarray

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """The row of each id, -1 without one."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def lists(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths of the lists of ``rows``, their entries' places in ``near``)."""
        sizes = self.first[rows + 1] - self.first[rows]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return sizes, np.repeat(self.first[rows], sizes) + within

    def radii(self, corners: list[np.ndarray], beta: float) -> np.ndarray:
        """The discrete radius of triangles of rows, NaN without a centre."""
        steps = range(0, len(corners[0]), STEP_TRIANGLES)
        parts = [self._radii([c[s:s + STEP_TRIANGLES] for c in corners], beta) for s in steps]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _radii(self, corners: list[np.ndarray], beta: float) -> np.ndarray:
        """A point's distances to the neighbours of another are measured once for all triangles with both."""
        pairs = np.concatenate([p.astype(np.int64) * len(self.x) + y for y in corners for p in corners])
        pairs, which = np.unique(pairs, return_inverse=True)
        point, owner = np.divmod(pairs, len(self.x))
        sizes, places = self.lists(owner)
        start, d = np.cumsum(sizes) - sizes, np.empty(len(places))
        anchor, step = np.repeat(point, sizes), max(1, STEP_ENTRIES // self.x.shape[1])
        for s in range(0, len(d), step):
            gap = self.x[anchor[s:s + step]].astype(np.float64) - self.x[self.near[places[s:s + step]]]
            d[s:s + step] = np.sqrt(np.maximum(np.einsum("ij,ij->i", gap, gap), SQUARE_FLOOR))
        n = len(corners[0])
        which, far, lo = which.reshape(3, 3, n), [], np.full(n, np.inf)
        for pair in which:  # the neighbours of one corner, from all three
            many = sizes[pair[0]]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            each = np.stack([d[np.repeat(start[p], many) + within] for p in pair])
            top = each.max(axis=0)
            some = np.flatnonzero(many)
            far.append((top + np.log(np.exp(beta * (each - top)).sum(axis=0)) / beta, many, some))
            if len(some):
                lo[some] = np.minimum(lo[some], np.minimum.reduceat(far[-1][0], (np.cumsum(many) - many)[some]))
        total = np.zeros(n)
        for reach, many, some in far:
            if len(some):
                near = np.exp(-beta * (reach - np.repeat(lo, many)))
                total[some] += np.add.reduceat(near, (np.cumsum(many) - many)[some])
        return np.where(total > 0, lo - np.log(np.where(total > 0, total, 1.0)) / beta, np.nan)


def _single(packed: DataFrame) -> bool:
    """Whether all vectors are of single precision."""
    return packed.where(F.exists("v", lambda x: x != x.cast("float").cast("double"))).isEmpty()


def _held(packed: DataFrame) -> _Held | None:
    """Packs as arrays for the tasks, if they are small, ids are unique and no list names a point twice."""
    shape = packed.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.sum(F.size("js")).alias("links")
    ).first()
    if not shape["n"] or shape["n"] * (4 * shape["width"] + 16) + 8 * shape["links"] > HELD_BYTES:
        return None
    single = _single(packed)
    if shape["n"] * ((4 if single else 8) * shape["width"] + 16) + 8 * shape["links"] > HELD_BYTES:
        return None
    rows = packed.select("i", F.col("v").cast("array<float>" if single else "array<double>").alias("v"), "js").toArrow()
    rows = rows.sort_by("i").combine_chunks()
    ids, js = rows.column("i").to_numpy(), rows.column("js").combine_chunks()
    x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    held = _Held(ids, x, list_offsets(js), js.flatten().to_numpy())
    held.near = held.rows(held.near)
    link = np.repeat(np.arange(len(ids)), np.diff(held.first)) * len(ids) + held.near
    if len(np.unique(ids)) < len(ids) or len(np.unique(link)) < len(link) or (held.near < 0).any():
        return None
    return held


def discrete_radii(triplets: DataFrame, packed: DataFrame, beta: float = 10.0) -> DataFrame:
    """Adds ``r``: the best centre is sought among the neighbours of the three corners.

    Centres listed by two corners count twice. Packs of up to ``HELD_BYTES`` go to the tasks, and triangles are not
    shuffled. Beyond, a triangle takes the vectors of its corners along and visits each
    corner's neighbours in turn, so those never travel with it; vectors of single precision travel in it.
    """
    held = _held(packed)
    if held is not None:
        shared = packed.sparkSession.sparkContext.broadcast(held)

        def radius(batch):
            rows = [shared.value.rows(batch.column(c).to_numpy()) for c in "ijk"]
            known = np.minimum.reduce(rows) >= 0
            r = np.full(len(known), np.nan)
            r[known] = shared.value.radii([x[known] for x in rows], beta)
            return {"r": pa.array(r, mask=np.isnan(r)), "_known": pa.array(known)}

        rows = triplets.where("i IS NOT NULL AND j IS NOT NULL AND k IS NOT NULL")
        return add_columns(rows, [], radius, {"r": "double", "_known": "boolean"}).where("_known").drop("_known")
    kind = "array<float>" if _single(packed) else "array<double>"
    vector = lambda c: packed.select(F.col("i").alias(c), F.col("v").cast(kind).alias(f"_v{c}"))
    rows = triplets.join(vector("j"), "j").join(vector("k"), "k")
    rows = rows.withColumns({"_lo": F.lit(float("inf")), "_sum": F.lit(0.0)})
    for c in "ijk":
        near = packed.select(
            F.col("i").alias(c), F.col("v").cast(kind).alias(f"_v{c}"), F.col("nv").cast(kind).alias("_n")
        )
        rows = add_columns(
            rows.drop(f"_v{c}").join(near, c), ["_n", "_lo", "_sum"],
            lambda batch: _nearer_centres(batch, beta), {"_lo": "double", "_sum": "double"},
        )
    return rows.withColumn("r", F.col("_lo") - F.log("_sum") / beta).drop("_lo", "_sum", *[f"_v{c}" for c in "ijk"])


def weighted_candidates_discrete(packed: DataFrame, max_d: float, beta: float = 10.0) -> DataFrame:
    """``weighted_candidates`` with the discrete radius: every candidate meets the neighbours of its three corners once."""
    lists, scale = packed.select("i", "js"), -2.0 / max(float(max_d), REACH_FLOOR)
    held = _held(packed)
    if held is not None:
        shared = packed.sparkSession.sparkContext.broadcast(held)

        def weigh(batch):
            ks, h = batch.column("ks"), shared.value
            row = _rows_of(list_offsets(ks))
            at = [h.rows(batch.column(c).to_numpy())[row] for c in "ij"]
            w = np.exp(h.radii([*at, h.rows(ks.flatten().to_numpy())], beta) * scale)
            return {"ws": list_array(w, np.bincount(row, minlength=batch.num_rows))}

        return add_columns(candidate_triangles(lists), [], weigh, {"ws": "array<double>"})
    rows = candidate_triangles(lists).select("i", "j", F.posexplode_outer("ks").alias("pos", "k"))
    real = rows.where("k IS NOT NULL")
    weighed = discrete_radii(real, packed, beta).withColumn("w", F.exp(F.col("r") * F.lit(scale))).select("i", "j", "pos", "k", "w")
    bare = rows.where("k IS NULL").select("i", "j", F.expr("0 AS pos"), "k", F.lit(None).cast("double").alias("w"))
    lined = weighed.union(bare).groupBy("i", "j").agg(
        F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("pos", "k", "w")))).alias("l")
    )
    return lined.select("i", "j", F.col("l.k").alias("ks"), F.col("l.w").alias("ws"))


def triangle_weights(
    triplets: DataFrame, points: DataFrame, packed: DataFrame | None, max_d: float,
    mode: str = "euclidean", soft: bool = True, beta: float = 10.0, beta_discrete: float = 10.0,
) -> DataFrame:
    """Adds ``w`` = exp(-2 r / max_d). The euclidean r is the ball's diameter, the discrete r its radius."""
    if mode == "euclidean":
        rows, factor = euclidean_radii(triplets, points, soft, beta), 2.0
    elif mode == "discrete":
        rows, factor = discrete_radii(triplets, packed, beta_discrete), 1.0
    else:
        raise ValueError(f"unknown radius mode {mode!r}; use 'euclidean' or 'discrete'")
    w = F.exp(F.col("r") * F.lit(-2.0 * factor / max(float(max_d), REACH_FLOOR)))
    return rows.withColumn("w", w).drop("r")
