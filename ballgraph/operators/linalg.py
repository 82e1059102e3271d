"""Gram matrices, PCA and truncated SVD."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions import draws
from ballgraph.functions.arrow import add_columns, list_array
from ballgraph.functions.vectors import list_matrix, list_offsets
from ballgraph.session import Scratch
from ballgraph.sources.points import dense_codes

GRAM_WIDTH_LIMIT = 4096         # a width x width matrix must fit one task and the driver
BROADCAST_BYTES = 64 << 20      # largest side that is broadcast instead of shuffled
TOLERANCE = 1e-6                # residual of an eigenpair, as a share of the largest eigenvalue
MAX_PASSES = 200                # guard of the block iteration
DEPENDENT = 1e-12               # share of the largest below which a direction depends on others
PARTIAL_ROWS = 4096             # rows per batch of a partial factor
STEP_ENTRIES = 1 << 20          # cells * columns of a block multiplied at a time


def _partial_gram(batches):
    """One row per task: count, column sums and upper cross products of its points."""
    n, total, cross = 0, None, None
    for batch in batches:
        x = list_matrix(batch.column("v"))
        if not len(x):
            continue
        if total is None:
            total, cross = np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
        n += len(x)
        total += x.sum(axis=0)
        cross += x.T @ x
    if n:
        yield pa.RecordBatch.from_pydict({
            "n": pa.array([float(n)]),
            "total": pa.array([total]),
            "cross": pa.array([cross.ravel()]),
        })


def _add_partials(batches):
    n, total, cross = 0.0, 0.0, 0.0
    for batch in batches:
        n += batch.column("n").to_numpy().sum()
        total = total + list_matrix(batch.column("total")).sum(axis=0)
        cross = cross + list_matrix(batch.column("cross")).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_pydict(
            {"n": pa.array([n]), "total": pa.array([total]), "cross": pa.array([cross])}
        )


PARTIAL_SCHEMA = "n double, total array<double>, cross array<double>"


def folded(partials: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Sum of the tasks' partial rows: folded by a few tasks first, then on the driver."""
    fold = max(1, int(partials.sparkSession.sparkContext.defaultParallelism ** 0.5))
    n, total, cross = 0.0, 0.0, 0.0
    for row in partials.repartition(fold).mapInArrow(_add_partials, PARTIAL_SCHEMA).toLocalIterator():
        n, total, cross = n + row.n, total + np.array(row.total), cross + np.array(row.cross)
    return int(n), total, cross


def gram(points: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance with divisor n-1); only matrices of the width reach the driver."""
    if width > GRAM_WIDTH_LIMIT:
        raise ValueError(f"width {width} is above {GRAM_WIDTH_LIMIT}; use pca, which avoids the square matrix")
    n, total, cross = folded(points.select("v").mapInArrow(_partial_gram, PARTIAL_SCHEMA))
    mean = total / n
    centred = cross.reshape(width, width) - n * np.outer(mean, mean)
    return n, mean, centred / max(n - 1.0, 1.0)


def gram_table(points: DataFrame, width: int) -> DataFrame:
    """The means and covariances as rows (a, b, mean_a, cov) with a <= b."""
    _, mean, cov = gram(points, width)
    a, b = np.triu_indices(width)
    rows = pd.DataFrame({"a": a, "b": b, "mean_a": mean[a], "cov": cov[a, b]})
    return points.sparkSession.createDataFrame(rows, "a bigint, b bigint, mean_a double, cov double")


def _fix_signs(components: np.ndarray) -> np.ndarray:
    """Each column's entry of largest size is made positive, so that results are repeatable."""
    top = np.abs(components).argmax(axis=0)
    return components * np.where(components[top, np.arange(components.shape[1])] < 0, -1.0, 1.0)


def project(points: DataFrame, mean: np.ndarray, components: np.ndarray, out: str = "v") -> DataFrame:
    """(v - mean) @ components for every point; the factor is width x components."""
    shared = points.sparkSession.sparkContext.broadcast((mean, components))
    keep = [c for c in points.columns if c != "v"]

    def run(batches):
        centre, comps = shared.value
        for batch in batches:
            x = list_matrix(batch.column("v"))
            y = (x - centre) @ comps if len(x) else np.zeros((0, comps.shape[1]))
            flat = pa.array(y.ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * comps.shape[1])
            lists = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [lists], keep + [out])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema if f.name != "v")
    return points.mapInArrow(run, f"{fields}, {out} array<double>")


def pca_model(points: DataFrame, n_components: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, width x n components, variances), largest variance first."""
    n, mean, cov = gram(points, width)
    variances, vectors = np.linalg.eigh(cov)
    order = np.argsort(variances)[::-1][: min(n_components, width)]
    return mean, _fix_signs(vectors[:, order]), variances[order]


def pca(points: DataFrame, n_components: int, width: int | None = None) -> DataFrame:
    """Centred projection on the leading components; every other column is kept."""
    width = width or points.select(F.size("v")).first()[0]
    if width > GRAM_WIDTH_LIMIT:
        mean, components, _ = wide_pca_model(points, n_components, width)
    else:
        mean, components, _ = pca_model(points, n_components, width)
    return project(points, mean, components)


def wide_pca_model(
    points: DataFrame, n_components: int, width: int, oversample: int = 8, seed: int = 0,
    tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pca_model`` without the width x width matrix: block iteration with width x few matrices."""
    spark = points.sparkSession
    mean = np.array(points.agg(vector_to_array(Summarizer.mean(array_to_vector("v")))).first()[0])
    few = min(n_components + oversample, width)
    rows = points.count()

    def image(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((mean, basis))

        def multiply(batches):
            centre, block = shared.value
            n, cross = 0, 0.0
            for batch in batches:
                x = list_matrix(batch.column("v"))
                if len(x):
                    x = x - centre
                    n, cross = n + len(x), cross + x.T @ (x @ block)
            if n:
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([float(n)]), "total": pa.array([[0.0]]), "cross": pa.array([cross.ravel()]),
                })

        _, _, cross = folded(points.select("v").mapInArrow(multiply, PARTIAL_SCHEMA))
        return cross.reshape(width, basis.shape[1])

    keep = min(n_components, few)
    start = np.random.default_rng(seed).normal(size=(width, few))
    top, values = leading_pairs(ArrayBlocks(), start, image, few, keep, tolerance, max_passes)
    return mean, _fix_signs(top), values / max(rows - 1.0, 1.0)


class ArrayBlocks:
    """Blocks of columns as arrays."""

    def beside(self, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        return np.hstack([left, right])

    def products(self, block: np.ndarray, width: int) -> np.ndarray:
        return block.T @ block

    def times(self, block: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        return block @ matrix


class TableBlocks:
    """Blocks of columns as tables (code, q), written where a later step reads them more than once."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.steps = scratch, 0

    def beside(self, left: DataFrame, right: DataFrame, width: int) -> DataFrame:
        """The columns of both; a row that ``right``, of this width, lacks is zero there."""
        zero = F.array(*[F.lit(0.0)] * width)
        both = left.join(right.select("code", F.col("q").alias("more")), "code", "left").select(
            "code", F.concat("q", F.coalesce("more", zero)).alias("q")
        )
        self.steps += 1
        held = self.scratch.save(both, f"basis{self.steps}")
        if self.steps > 1:  # ``left`` was made from the basis before, which is read no more
            self.scratch.drop(f"basis{self.steps - 1}")
        return held

    def products(self, block: DataFrame, width: int) -> np.ndarray:
        return block_gram(block, width)

    def times(self, block: DataFrame, matrix: np.ndarray) -> DataFrame:
        return rotate(block, "code", matrix)


def _ritz(products: np.ndarray, size: int, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, mixing matrix and residuals of the leading pairs of A in span S, from the products of [S, A S].

    Directions of S that depend on others to rounding are left out.
    """
    own, cross, far = products[:size, :size], products[:size, size:], products[size:, size:]
    length = np.sqrt(np.maximum(np.diag(own), 0.0))
    scale = np.where(length > 0, 1.0 / np.where(length > 0, length, 1.0), 0.0)
    values, vectors = np.linalg.eigh(own * scale[:, None] * scale)
    held = values > values.max() * DEPENDENT
    white = scale[:, None] * vectors[:, held] / np.sqrt(values[held])
    values, vectors = np.linalg.eigh(white.T @ ((cross + cross.T) / 2.0) @ white)
    values, mix = values[::-1][:few], white @ vectors[:, ::-1][:, :few]
    of = lambda m: np.einsum("ac,ab,bc->c", mix, m, mix)
    residual = np.sqrt(np.maximum(of(far) - 2.0 * values * of(cross) + values ** 2 * of(own), 0.0))
    return values, mix, residual


def leading_pairs(blocks, start, image, few: int, keep: int, tolerance: float, max_passes: int):
    """(block of ``keep`` vectors, values): leading eigenpairs of a positive operator known by its ``image`` of a block.

    Each pass searches the span of the current vectors, their residuals and the last steps, so it needs one image of a
    block of ``few`` columns. It ends when no wanted pair's residual, the length of A x - value x, is above
    ``tolerance`` times the largest value; a warning tells if that took too many passes.
    """
    basis, size = blocks.beside(start, image(start), few), few
    for done in range(max_passes + 1):
        values, mix, residual = _ritz(blocks.products(basis, 2 * size), size, few)
        worst = residual[:keep].max() / max(values[0], 1e-300)
        if worst <= tolerance or done == max_passes:
            break
        none = np.zeros_like(mix)
        step = mix.copy()
        step[:few] = 0.0  # without the part along the vectors before
        steps = [step] if size > few else []
        scaled = mix / np.maximum(residual, values[0] * 1e-12)
        parts = [np.vstack([m, none]) for m in [mix, *steps]] + [np.vstack([-scaled * values, scaled])]
        parts += [np.vstack([none, m]) for m in [mix, *steps]]
        own = few * (len(steps) + 1)
        moved = blocks.times(basis, np.hstack(parts))
        rest = np.eye(few * len(parts))[:, own:own + few]
        basis, size = blocks.beside(moved, image(blocks.times(moved, rest)), few), own + few
    if worst > tolerance:
        warnings.warn(f"the block iteration stopped after {max_passes} passes with a residual of {worst:.1e}", stacklevel=3)
    return blocks.times(basis, np.vstack([mix, np.zeros_like(mix)])[:, :keep]), values[:keep]


def block_gram(block: DataFrame, width: int) -> np.ndarray:
    """Cross products of a (key, q) block, width x width."""
    n, mean, cov = gram(block.select(F.col("q").alias("v")), width)
    return cov * max(n - 1.0, 1.0) + n * np.outer(mean, mean)


def rotate(block: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Every row of a (key, q) block times a small matrix."""
    zero = np.zeros(matrix.shape[0])
    return project(block.select(key, F.col("q").alias("v")), zero, matrix, out="q")


def orthonormalise(block: DataFrame, key: str, width: int) -> DataFrame:
    """Orthonormal columns spanning the block (directions without length are dropped to zero)."""
    values, vectors = np.linalg.eigh(block_gram(block, width))
    scale = np.where(values > values.max() * 1e-12, 1.0 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return rotate(block, key, vectors * scale)


def truncated_svd(
    terms: DataFrame, n_components: int, oversample: int = 8, seed: int = 0, ids: DataFrame | None = None,
    tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES,
) -> tuple[DataFrame, np.ndarray]:
    """Uncentred SVD of a sparse (id, term, value) table: rows U*S as (id, v), and S.

    ``leading_pairs`` of A^T A on tables of terms. While a block of terms is below ``BROADCAST_BYTES`` it is sent to the
    tasks, which read the packed rows once and shuffle only their partial images; beyond that, both products are joins
    and grouped sums. ``ids`` adds zero rows for ids without any term.
    """
    scratch = Scratch(terms.sparkSession, "svd")
    terms = scratch.save(terms.select("id", "term", "value"), "cells")
    codes = dense_codes(terms.select("term").distinct(), "term", "code", scratch)
    codes = scratch.save(codes, "terms")
    packed = scratch.save(
        terms.join(codes, "term").groupBy("id").agg(
            F.collect_list(F.struct("code", "value")).alias("cells")
        ).select("id", F.col("cells.code").alias("codes"), F.col("cells.value").alias("values")),
        "rows",
    )
    n_terms, n_rows = codes.count(), packed.count()
    few = min(n_components + oversample, n_terms, n_rows)
    keep = min(n_components, few)
    draw = F.array(*[F.expr(draws.gauss((seed, c), "term")) for c in range(few)])
    start = scratch.save(codes.select("code", draw.alias("q")), "start")
    small = n_terms * (few * 8 + 40) <= BROADCAST_BYTES
    cells = packed.select("id", F.inline(F.arrays_zip("codes", "values"))).select(
        "id", F.col("codes").alias("code"), F.col("values").alias("value")
    )

    def image(block: DataFrame) -> DataFrame:
        if small:
            return _packed_image(packed, _dense(block, n_terms, few))
        left = scratch.save(_weighted_sum(cells, block, "code", "id", n_terms * (few * 8 + 40)), "left")
        return _weighted_sum(cells, left, "id", "code", n_rows * (few * 8 + 24))

    top, values = leading_pairs(TableBlocks(scratch), start, image, few, keep, tolerance, max_passes)
    top = scratch.save(top, "vectors")
    top = scratch.save(rotate(top, "code", np.diag(leading_signs(top, "code", keep))), "components")
    if small:
        shared = terms.sparkSession.sparkContext.broadcast(_dense(top, n_terms, keep))

        def run(batch):
            y = np.concatenate([_times(part, shared.value) for part in _steps(batch, keep)])
            return {"v": list_array(y.ravel(), np.full(len(y), keep))}

        rows = add_columns(packed, ["codes", "values"], run, {"v": "array<double>"})
    else:
        rows = _weighted_sum(cells, top, "code", "id", n_terms * (keep * 8 + 40)).withColumnRenamed("q", "v")
    if ids is not None:
        zero = F.array(*[F.lit(0.0)] * keep)
        rows = ids.select("id").join(rows, "id", "left").select("id", F.coalesce("v", zero).alias("v"))
    return rows, np.sqrt(np.maximum(values, 0.0))


def _dense(block: DataFrame, n: int, width: int) -> np.ndarray:
    """A block below BROADCAST_BYTES as an array whose rows follow the codes."""
    held = block.toArrow()
    out = np.zeros((n, width))
    out[held.column("code").to_numpy()] = list_matrix(held.column("q").combine_chunks())
    return out


def _sparse_rows(batch):
    """Codes, values and row number of every cell of a batch of packed rows."""
    offsets = list_offsets(batch.column("codes"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    return batch.column("codes").flatten().to_numpy(), batch.column("values").flatten().to_numpy(), row, offsets


def _steps(batch, width: int):
    """Runs of packed rows with a bounded number of cells, a row at least."""
    ends = list_offsets(batch.column("codes"))
    lo, most = 0, max(1, STEP_ENTRIES // max(width, 1))
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _times(batch, block: np.ndarray) -> np.ndarray:
    """Packed rows times a dense block."""
    codes, values, _, offsets = _sparse_rows(batch)
    return np.add.reduceat(values[:, None] * block[codes], offsets[:-1], axis=0)


def _packed_image(packed: DataFrame, block: np.ndarray) -> DataFrame:
    """(code, q): A^T A times a block. A task holds the block and its own partial image and sends the rows it touched."""
    n_terms, few = block.shape
    shared = packed.sparkSession.sparkContext.broadcast(block)

    def multiply(batches):
        block, total = shared.value, np.zeros((n_terms, few))
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in _steps(batch, few):
                codes, values, row, _ = _sparse_rows(part)
                order = np.argsort(codes, kind="stable")
                code, first = np.unique(codes[order], return_index=True)
                gain = values[order, None] * _times(part, block)[row[order]]
                total[code] += np.add.reduceat(gain, first, axis=0)
        touched = np.flatnonzero(total.any(axis=1))
        for s in range(0, len(touched), PARTIAL_ROWS):
            part = touched[s:s + PARTIAL_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), list_array(total[part].ravel(), np.full(len(part), few))], ["code", "q"]
            )

    partial = packed.mapInArrow(multiply, "code bigint, q array<double>")
    return partial.groupBy("code").agg(vector_to_array(Summarizer.sum(array_to_vector("q"))).alias("q"))


def _weighted_sum(cells: DataFrame, factor: DataFrame, on: str, by: str, bytes_: int) -> DataFrame:
    """Sparse matrix times block: sums value * row of ``factor`` per ``by``, inside the JVM."""
    side = F.broadcast(factor) if bytes_ <= BROADCAST_BYTES else factor
    scaled = cells.join(side, on).select(
        by, array_to_vector(F.transform("q", lambda x: x * F.col("value"))).alias("s")
    )
    return scaled.groupBy(by).agg(vector_to_array(Summarizer.sum(F.col("s"))).alias("q"))


def leading_signs(block: DataFrame, key: str, width: int) -> np.ndarray:
    """Sign that makes the largest entry of every column positive."""
    tops = [
        F.max_by(F.get("q", F.lit(c)), F.struct(F.abs(F.get("q", F.lit(c))), F.col(key)))
        for c in range(width)
    ]
    row = block.agg(*[t.alias(f"c{c}") for c, t in enumerate(tops)]).first()
    return np.array([-1.0 if v < 0 else 1.0 for v in row])
