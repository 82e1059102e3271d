"""Low-dimensional discrete radius of positive triangles and its gradient.

The radius of a triangle is a soft minimum, over the neighbours of its corners as ball centres, of the
soft maximum of the three corner distances; corners and centres all receive gradient.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions.kernels import LOG_FLOOR, TAU_FLOOR
from ballgraph.functions.vectors import list_matrix, list_offsets
from ballgraph.operators.cech import _rows_of, soft_reach
from ballgraph.operators.loss import coords


def layout_packs(wide: DataFrame, lists: DataFrame, n_components: int) -> DataFrame:
    """(i, y, js, ny): coordinates of a point and of its neighbours, flattened in rank order."""
    at = wide.select(F.col("id").alias("j"), F.array(*coords(n_components)).alias("y"))
    near = lists.select("i", F.posexplode("js").alias("pos", "j")).join(at, "j")
    lined = near.groupBy("i").agg(
        F.array_sort(F.collect_list(F.struct("pos", "j", "y"))).alias("l")
    ).select("i", F.col("l.j").alias("js"), F.flatten("l.y").alias("ny"))
    return at.withColumnRenamed("j", "i").join(lined, "i", "left").select(
        "i", "y", F.expr("coalesce(js, cast(array() as array<bigint>))").alias("js"),
        F.expr("coalesce(ny, cast(array() as array<double>))").alias("ny"),
    )


def _corner_data(batch):
    """Corners (3, rows, d), centre ids and positions grouped by row, and the row offsets."""
    corner = [list_matrix(batch.column(f"y_{c}")) for c in "ijk"]
    row, ids, centre = [], [], []
    for c in "ijk":
        row.append(_rows_of(list_offsets(batch.column(f"js_{c}"))))
        ids.append(batch.column(f"js_{c}").flatten().to_numpy())
        centre.append(batch.column(f"ny_{c}").flatten().to_numpy().reshape(len(ids[-1]), -1))
    order = np.argsort(np.concatenate(row), kind="stable")
    row, ids, centre = (np.concatenate(x)[order] for x in (row, ids, centre))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
    return np.stack(corner), row, ids, centre, offsets


def _attract(r: np.ndarray, phi: str, tau: float):
    tau = max(tau, TAU_FLOOR)
    q = 1.0 / (1.0 + r * r) if phi == "student" else np.exp(-r / tau)
    slope = 2.0 * r / (1.0 + r * r) if phi == "student" else np.full_like(r, 1.0 / tau)
    return -np.log(np.maximum(q, LOG_FLOOR)), np.where(q >= LOG_FLOOR, slope, 0.0)


def discrete_gradient_rows(
    positives: DataFrame, packed: DataFrame, n_components: int, n_positive: int, alpha: float = 1.0,
    phi: str = "student", tau: float = 1.0, beta: float = 10.0,
) -> DataFrame:
    """(id, g0.., loss) rows of the positives (i, j, k, w), already summed inside each batch."""
    rows = positives.select("i", "j", "k", "w")
    for c in "ijk":
        rows = rows.join(
            packed.select(F.col("i").alias(c), F.col("y").alias(f"y_{c}"), F.col("js").alias(f"js_{c}"),
                          F.col("ny").alias(f"ny_{c}")), c)
    scale = float(alpha) / max(n_positive, 1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            corner, row, ids, centre, offsets = _corner_data(batch)
            gap = corner[:, row] - centre                       # (3, centres, d)
            d = np.sqrt((gap ** 2).sum(axis=2))
            radius, far = soft_reach(d, offsets, beta)
            w = batch.column("w").to_numpy()
            loss, slope = _attract(2.0 * radius, phi, tau)
            pull = 2.0 * w * slope * scale
            low = np.minimum.reduceat(far, offsets[:-1])[row]
            near = np.exp(-beta * (far - low))
            near /= np.add.reduceat(near, offsets[:-1])[row]    # share of each centre
            top = np.exp(beta * (d - d.max(axis=0)))
            top /= top.sum(axis=0)                              # share of each corner
            force = pull[row] * near * top                      # dL/dd, (3, centres)
            g = np.where(d > 0, force / np.where(d > 0, d, 1.0), 0.0)[:, :, None] * gap
            at_corner = np.stack([np.add.reduceat(x, offsets[:-1], axis=0) for x in g])
            vertex = np.concatenate([batch.column(c).to_numpy() for c in "ijk"] + [ids])
            values = np.concatenate([at_corner.reshape(-1, n_components), -g.sum(axis=0)])
            booked = np.zeros(len(vertex))
            booked[: batch.num_rows] = w * loss / max(n_positive, 1)
            unique, where = np.unique(vertex, return_inverse=True)
            sums = [np.bincount(where, weights=values[:, c]) for c in range(n_components)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(unique), *[pa.array(s) for s in sums],
                 pa.array(np.bincount(where, weights=booked))],
                ["id", *coords(n_components, "g"), "loss"],
            )

    fields = ", ".join(f"{g} double" for g in coords(n_components, "g"))
    return rows.mapInArrow(run, f"id bigint, {fields}, loss double")
