"""Column expressions on array<double> vectors, and their Arrow views inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def divide(v: Column, c) -> Column:
    c = c if isinstance(c, Column) else F.lit(float(c))
    return F.transform(v, lambda x: x / c)


def l2_normalised(v: Column, eps: float | None = None) -> Column:
    """Row over its norm. Zero rows stay zero; with ``eps`` the norm is clamped from below instead."""
    n = norm(v)
    if eps is not None:
        return divide(v, F.greatest(n, F.lit(float(eps))))
    return F.when(n > 0, divide(v, n)).otherwise(v)


def list_matrix(array) -> np.ndarray:
    """Arrow list column of equal-length rows -> (rows, width) float64 matrix."""
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def list_offsets(array) -> np.ndarray:
    """Row lengths of an Arrow list column as offsets starting at 0."""
    lengths = array.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
