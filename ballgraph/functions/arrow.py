"""Row-preserving Arrow kernels: new columns computed from vectors, other columns passed through."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def add_columns(df: DataFrame, drop: list[str], fn: Callable, fields: dict[str, str]) -> DataFrame:
    """``fn(batch) -> {name: arrow array}`` adds ``fields``; the columns in ``drop`` end here."""
    keep = [c for c in df.columns if c not in drop]
    names = keep + list(fields)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    schema += "".join(f", `{c}` {t}" for c, t in fields.items())

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                new = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [new[c] for c in fields], names
                )

    return df.mapInArrow(run, schema.lstrip(", "))


def list_array(values: np.ndarray, lengths: np.ndarray):
    """Flat values and row lengths -> Arrow list column."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
