"""Whitening of embeddings by a bidiagonal qd solver.

The distinct vectors are fitted: exact sums centre them, blocks of centred rows become triangular factors by QR, and a
tree of QRs leaves one factor R. Its bidiagonal form gives singular values by dqds and the whitening directions by twisted
factorisations (``qd``). Only R, whose size is the dimension squared, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.llm.qd import singular_pairs
from ballgraph.session import Scratch

#: Factors that one task of a tree level combines, and rows of a block in multiples of the dimension.
FAN = 16
BLOCK = 8
#: The longest vectors: R, with dimension squared doubles, is held by a task and by the driver.
MAX_DIMENSION = 4096

_WIDTHS = [(1, np.int8), (2, np.int16), (4, np.int32), (8, np.int64)]


def pack_vectors(column: pa.ListArray, scale: float) -> tuple[list[bytes | None], np.ndarray]:
    """Packed floor(scale * entry) of each vector and its length; None for a null vector, a null or non-finite entry.

    The narrowest of four integer widths that holds a vector is used, so equal vectors have equal bytes. Values beyond
    64 bits saturate.
    """
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    flat = column.flatten()
    bad = np.asarray(flat.is_null())
    values = np.asarray(flat.cast(pa.float64()).fill_null(0.0)) * scale
    bad = bad | ~np.isfinite(values)
    values = np.floor(np.where(bad, 0.0, values))
    x = np.clip(values, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    ends = np.cumsum(np.maximum(lengths, 0))
    out: list[bytes | None] = []
    for n, end in zip(lengths.tolist(), ends.tolist()):
        row = x[end - n:end] if n > 0 else x[:0]
        if n < 0 or bad[end - max(n, 0):end].any():
            out.append(None)
            continue
        low, high = (int(row.min()), int(row.max())) if n else (0, 0)
        width, kind = next(w for w in _WIDTHS if np.iinfo(w[1]).min <= low and high <= np.iinfo(w[1]).max)
        out.append(bytes([width]) + row.astype(kind).tobytes())
    return out, lengths


def unpack_vectors(packed: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(packed), d), np.int64)
    kinds = dict(_WIDTHS)
    for i, x in enumerate(packed):
        out[i] = np.frombuffer(x, kinds[x[0]], offset=1)
    return out


def packed_rows(rows: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, d, x) of the rows whose vector is whole."""
    kind = rows.select(id_column).schema[0].dataType.simpleString()
    schema = pa.schema([("d", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for batch in batches:
            packed, lengths = pack_vectors(batch.column(1), scale)
            keep = pa.array([p is not None for p in packed])
            more = [pa.array(lengths, pa.int32()).filter(keep), pa.array(packed, pa.binary()).filter(keep)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), *more], names=["id", *schema.names])

    two = rows.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return two.mapInArrow(run, f"id {kind}, d int, x binary")


def folded(parts: DataFrame, combine: Callable[[list[bytes]], bytes], scratch: Scratch, label: str) -> bytes | None:
    """One state out of many (part, state) rows of bounded size, combined by a tree of ``FAN`` rows a task."""
    now, level = scratch.save(parts, f"{label}-0"), 0
    while (n := now.count()) > FAN:
        groups = -(-n // FAN)

        def run(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("part").to_numpy())  # the same sums after a retry
            states = table.column("state").take(pa.array(order)).to_pylist()
            return pa.table({"part": table.column("g").slice(0, 1), "state": pa.array([combine(states)], pa.binary())})

        dealt = now.withColumn("g", F.pmod("part", F.lit(groups)))
        now = scratch.save(dealt.groupBy("g").applyInArrow(run, "part bigint, state binary"), f"{label}-{(level := level + 1)}")
        scratch.drop(f"{label}-{level - 1}")
    states = [r["state"] for r in now.orderBy("part").collect()]  # at most FAN
    scratch.drop(f"{label}-{level}")
    return combine(states) if states else None


def _by_task(rows: DataFrame, run: Callable) -> DataFrame:
    """(part, state): the state that ``run`` leaves of each task's rows."""
    return rows.mapInArrow(run, "state binary").select(F.spark_partition_id().cast("bigint").alias("part"), "state")


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of fitted vectors and the sum of each dimension, as Python integers."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = unpack_vectors(batch.column(0).to_pylist(), d)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in (np.arange(-1, d), np.append(n, high), np.append(0, low))],
                names=["j", "high", "low"],
            )

    wide = "decimal(38,0)"
    sums = fit.select("x").mapInArrow(run, "j bigint, high bigint, low bigint").groupBy("j").agg(
        F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")
    )
    found = {r["j"]: (int(r["high"]), int(r["low"])) for r in sums.collect()}  # one row for each dimension
    if not found:
        return 0, [0] * d
    return found[-1][0], [(found[j][0] << 32) + found[j][1] for j in range(d)]


class Centre:
    """n * x - S, exact as 64-bit integers where they fit."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.widest = max((abs(s) for s in sums), default=0)

    def exact(self, x: np.ndarray) -> np.ndarray | None:
        most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
        if self.n * most + self.widest >= 2**63:
            return None
        return x * self.n - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision."""
        dev = self.exact(x)
        if dev is not None:
            return dev / self.n
        return x - np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n x - S)^2; None beyond a long."""
        dev = self.exact(x)
        if dev is not None and len(dev) and x.shape[1] * int(np.abs(dev).max()) ** 2 < 2**63:
            return np.einsum("ij,ij->i", dev, dev).tolist()
        out = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist())
        return [v if v < 2**63 else None for v in out]


def _blocks(batches, d: int) -> Iterator[np.ndarray]:
    """Integer rows in blocks of a few times the dimension."""
    rows: list[bytes] = []
    for batch in batches:
        rows += batch.column(0).to_pylist()
        while len(rows) >= BLOCK * max(d, 128):
            yield unpack_vectors(rows[: BLOCK * max(d, 128)], d)
            rows = rows[BLOCK * max(d, 128):]
    if rows:
        yield unpack_vectors(rows, d)


def triangular_factor(fit: DataFrame, d: int, centre: Centre, scratch: Scratch) -> np.ndarray:
    """R of the centred fitted vectors: R'R is their scatter matrix."""

    def reduced(rows: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(rows, mode="r")
        return r if len(r) == d else np.concatenate([r, np.zeros((d - len(r), d))])

    def run(batches):
        r = None
        for x in _blocks(batches, d):
            c = centre.centred(x)
            r = reduced(c if r is None else np.concatenate([r, c]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["state"])

    def combine(states: list[bytes]) -> bytes:
        return reduced(np.concatenate([np.frombuffer(s).reshape(d, d) for s in states])).tobytes()

    return np.frombuffer(folded(_by_task(fit.select("x"), run), combine, scratch, "factor")).reshape(d, d)


def whitened_covariance(fit: DataFrame, d: int, centre: Centre, directions: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Covariance, divisor n, of the whitened fitted vectors."""
    k = directions.shape[1]

    def packed(n: float, mean: np.ndarray, scatter: np.ndarray) -> bytes:
        return np.concatenate([[n], mean, scatter.ravel()]).tobytes()

    def joined(states: list[bytes]) -> bytes:
        """Counts, means and scatter matrices of several blocks as those of all."""
        every = np.stack([np.frombuffer(s) for s in states])
        n = every[:, 0].sum()
        mean = (every[:, :1] * every[:, 1:k + 1]).sum(axis=0) / n
        shift = every[:, 1:k + 1] - mean
        return packed(n, mean, every[:, k + 1:].sum(axis=0).reshape(k, k) + (shift * every[:, :1]).T @ shift)

    def run(batches):
        state = None
        for x in _blocks(batches, d):
            w = centre.centred(x) @ directions
            mean = w.mean(axis=0)
            own = packed(len(w), mean, (w - mean).T @ (w - mean))
            state = own if state is None else joined([state, own])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], names=["state"])

    state = np.frombuffer(folded(_by_task(fit.select("x"), run), joined, scratch, "moment"))
    return state[k + 1:].reshape(k, k) / state[0]


def whiten(
    rows: DataFrame, n_components: int = 4, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every whole vector and component.

    The integer vectors x = floor(``scale`` * entry) are whitened; the fit takes each distinct x once. A row whose vector
    is null or holds a null or non-finite entry is left out, and so is one of another length than most distinct vectors
    have (the longer one on a tie). Repeated rows and null ids come out as often as they occur. A component without
    variance cannot be whitened and is left out: one distinct vector, empty vectors or an empty table give no rows.
    ``deviation`` is null where it does not fit a long. Other columns are ignored. Vectors longer than
    ``MAX_DIMENSION`` raise an error before any work on them.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    kind = rows.select(id_column).schema[0].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double"
    )
    packed = packed_rows(rows, id_column, vector_column, scale)
    fit = scratch.save(packed.select("d", "x").distinct(), "fit")
    common = fit.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = common[0]["d"] if common else 0
    if d == 0:
        return spark.createDataFrame([], schema)
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of {d} entries; at most {MAX_DIMENSION}")
    fit = fit.where(F.col("d") == d)
    n, sums = exact_sums(fit, d)
    centre = Centre(n, sums)
    r = triangular_factor(fit, d, centre, scratch)
    values, vectors = singular_pairs(r, n_components)
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], schema)
    variances = values / n
    explained = variances * n / float((r * r).sum())
    directions = vectors / np.sqrt(variances)
    error = float(np.abs(whitened_covariance(fit, d, centre, directions, scratch) - np.eye(k)).max())
    sent = spark.sparkContext.broadcast((centre, directions))

    def run(batches):
        centre, directions = sent.value
        for batch in batches:
            x = unpack_vectors(batch.column(1).to_pylist(), d)
            w = centre.centred(x) @ directions
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(each), n), pa.int64()), pa.array(centre.deviations(x), pa.int64()).take(each),
                pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error)),
            ], names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return packed.where(F.col("d") == d).select("id", "x").mapInArrow(run, schema)
