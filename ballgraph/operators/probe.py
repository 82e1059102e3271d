"""Vector similarity joins by cells: points are grouped around pivots, and a query row is sent only
to the groups that can hold an answer.

A cell larger than ``CHUNK_ROWS`` is split by a hash of the id, and the queries of one chunk are split
again, so neither a popular cell nor a popular query target can fill one task. A task holds one chunk
of members as a matrix and streams its queries through it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions import draws
from ballgraph.functions.arrow import add_columns, list_array
from ballgraph.functions.vectors import list_matrix

CHUNK_ROWS = 4096           # members per chunk
SMALL_CELL = 512            # members per cell where few columns make pruning strong;
FEW_COLUMNS = 16            # beyond, most cells are probed and fewer, larger ones move less data:
WIDE_CHUNKS = 8             # so many times the members, while
CHUNK_BYTES = 16 << 20      # their vectors take no more than this
QUERY_ROWS = 1024           # queries multiplied with a chunk at a time, fewer where
WORK_ENTRIES = 4 << 20      # queries * members is larger
PAIR_ENTRIES = 1 << 20      # pairs * width measured again at a time
SEND_ENTRIES = 1 << 19      # entries of the vectors in one batch of planned queries
SPLIT_QUERIES = 65_536      # queries of one chunk handled by one task at most
MAX_PIVOTS = 4096
PIVOT_ENTRIES = 4 << 20     # pivots * width, the size bound of the broadcast
MAX_CHUNKS = 200_000        # bounds the broadcast table of chunks
ESTIMATE_ROWS = 10_000      # queries planned to estimate the number of probes
PLAN_ENTRIES = 1 << 19      # rows * pivots compared at a time when planning probes
BINS = 1 << 14              # steps of a query's histogram of distances, at most; it is used
BIN_SLOTS = 8               # where members * thresholds beyond so many
BIN_WORK = 1 << 17          # are worth what it costs a query, measured as about 0.25 ms,
BIN_SPREAD = 64.0           # and while no member's bound is so many times the usual one


@dataclass
class Cells:
    """Pivots and the chunks their cells were split into; small arrays for broadcasting."""

    pivots: np.ndarray
    cell: np.ndarray        # cell of each chunk
    rmin: np.ndarray        # distance range from the pivot to the members of each chunk
    rmax: np.ndarray
    has_zero: np.ndarray    # whether a chunk holds an all-zero vector

    def __len__(self) -> int:
        return len(self.cell)

    def between(self) -> np.ndarray:
        """Distances of the pivots, computed once in a process."""
        if not hasattr(self, "_between"):
            step = max(1, PLAN_ENTRIES // len(self.pivots))
            self._between = np.concatenate([
                _pivot_distances(self.pivots[s:s + step], self.pivots) for s in range(0, len(self.pivots), step)
            ])
        return self._between


def chunk_rows(width: int) -> int:
    """Members per chunk: more of many columns, as every chunk there is sent most of the queries."""
    if width <= FEW_COLUMNS:
        return CHUNK_ROWS
    return max(CHUNK_ROWS, min(WIDE_CHUNKS * CHUNK_ROWS, CHUNK_BYTES // (8 * width)))


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(sq, 0.0))


def hash_pivots(points: DataFrame, n_pivots: int, width: int, seed: int) -> np.ndarray:
    """The vectors with the smallest id hashes; their number is bounded by the broadcast size."""
    n_pivots = max(1, min(n_pivots, MAX_PIVOTS, PIVOT_ENTRIES // max(width, 1)))
    rows = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n_pivots).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.float64)


def assign_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, dp): nearest pivot and the distance to it."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            x = list_matrix(batch.column("v"))
            if not len(x):
                continue
            near = np.concatenate([
                _pivot_distances(x[s:s + QUERY_ROWS], shared.value).argmin(axis=1)
                for s in range(0, len(x), QUERY_ROWS)
            ])
            dp = np.sqrt(((x - shared.value[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(near.astype(np.int64)),
                 pa.array(dp), pa.array(~x.any(axis=1))],
                ["id", "v", "cell", "dp", "zero"],
            )

    return points.select("id", "v").mapInArrow(
        run, "id bigint, v array<double>, cell bigint, dp double, zero boolean"
    )


def split_cells(assigned: DataFrame, pivots: np.ndarray, n_rows: int) -> tuple[DataFrame, Cells]:
    """Adds ``chunk`` to assigned points and describes the chunks."""
    most = max(chunk_rows(pivots.shape[1]), -(-n_rows // (MAX_CHUNKS // 2)))
    sizes = np.zeros(len(pivots), dtype=np.int64)
    for row in assigned.groupBy("cell").count().collect():
        sizes[row["cell"]] = row["count"]
    parts = np.maximum(1, -(-sizes // most))
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    table = assigned.sparkSession.createDataFrame(
        [(int(c), int(p), int(f)) for c, (p, f) in enumerate(zip(parts, first))],
        "cell bigint, parts bigint, first bigint",
    )
    chunked = assigned.join(F.broadcast(table), "cell").withColumn(
        "chunk", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    ).drop("parts", "first")
    total = int(parts.sum())
    rmin, rmax = np.full(total, np.inf), np.full(total, -np.inf)
    has_zero = np.zeros(total, dtype=bool)
    stats = chunked.groupBy("chunk").agg(
        F.min("dp").alias("lo"), F.max("dp").alias("hi"), F.max("zero").alias("zero")
    )
    for row in stats.collect():
        rmin[row.chunk], rmax[row.chunk], has_zero[row.chunk] = row.lo, row.hi, row.zero
    cell = np.repeat(np.arange(len(pivots)), parts)
    return chunked, Cells(pivots, cell, rmin, rmax, has_zero)


def chunked(points: DataFrame, n: int, width: int, seed: int, scratch) -> tuple[DataFrame, Cells | None]:
    """Points with their chunk; one chunk and no cells while they fit one."""
    if n <= CHUNK_ROWS:
        return points.withColumn("chunk", F.lit(0).cast("bigint")), None
    per_cell = SMALL_CELL if width <= FEW_COLUMNS else chunk_rows(width)
    pivots = hash_pivots(points, max(16, n // per_cell), width, seed)
    assigned = scratch.save(assign_cells(points, pivots), "cells")
    members, cells = split_cells(assigned, pivots, n)
    members = scratch.save(members, "members")
    scratch.drop("cells")
    return members, cells


def _send(batch, rows: np.ndarray, chunks: np.ndarray, width: int):
    """One row per row number and chunk, in batches of bounded size however many chunks a query is sent to."""
    step = max(1, SEND_ENTRIES // max(width, 1))
    for s in range(0, len(rows), step):
        index = pa.array(rows[s:s + step])
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunks[s:s + step].astype(np.int64)), batch.column("id").take(index),
             batch.column("v").take(index), batch.column("aux").take(index)],
            ["chunk", "id", "v", "aux"],
        )


QUERY_SCHEMA = "chunk bigint, id bigint, v array<double>, aux array<double>"


def plan_by_bounds(queries: DataFrame, cells: Cells, metric: str, skip_own: bool) -> DataFrame:
    """Query rows (id, v, aux[, own]) -> one row per chunk that may hold a member within max(aux).

    A chunk is left out only if the triangle inequality or the bisector between two pivots proves
    that all its members are farther. On normalised vectors a cosine distance d is the length
    sqrt(2 d); all-zero vectors have no such length, so they are never left out.
    """
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        c = shared.value
        between, n_cells = c.between(), len(c.pivots)
        by_cell, parts = np.argsort(c.cell, kind="stable"), np.bincount(c.cell, minlength=n_cells)
        first, zeros = np.cumsum(parts) - parts, np.flatnonzero(c.has_zero)
        cell_max = np.full(n_cells, -1e300)
        np.maximum.at(cell_max, c.cell, c.rmax)
        rows_at_once = max(1, PLAN_ENTRIES // n_cells)
        for batch in batches:
            x = list_matrix(batch.column("v"))
            if not len(x):
                continue
            reach = list_matrix(batch.column("aux")).max(axis=1)
            own = batch.column("own").to_numpy() if skip_own else None
            zero = ~x.any(axis=1)
            if metric == "cosine":
                reach = np.where(zero, np.inf, np.sqrt(2.0 * np.maximum(reach, 0.0)))
            for s in range(0, len(x), rows_at_once):
                e = min(s + rows_at_once, len(x))
                dp = _pivot_distances(x[s:e], c.pivots)
                home = dp.argmin(axis=1)
                slack = 1e-7 * (1.0 + dp.max(axis=1) + np.where(np.isfinite(reach[s:e]), reach[s:e], 0.0))
                far = reach[s:e] + slack
                # few cells are near enough; the other bounds are taken for those only
                rows, at = _places(np.packbits(dp <= far[:, None] + cell_max, axis=1))
                to, mine = dp[rows, at], home[rows]
                gap = between[mine, at]
                bisector = (to ** 2 - dp[rows, mine] ** 2) / (2.0 * np.maximum(gap, 1e-300))
                near = np.where(gap == 0, 0.0, bisector) <= far[rows]
                rows, at, to = rows[near], at[near], to[near]
                many = parts[at]
                rows, to = np.repeat(rows, many), np.repeat(to, many)
                nth = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
                chunks = by_cell[np.repeat(first[at], many) + nth]
                keep = np.maximum(to - c.rmax[chunks], c.rmin[chunks] - to) <= far[rows]
                keep &= np.isfinite(c.rmin[chunks])
                rows, chunks = rows[keep], chunks[keep]
                if metric == "cosine" and len(zeros):
                    every = np.repeat(np.arange(e - s), len(zeros)) * len(c) + np.tile(zeros, e - s)
                    rows, chunks = np.divmod(np.union1d(rows * len(c) + chunks, every), len(c))
                if own is not None:
                    others = chunks != own[s:e][rows]
                    rows, chunks = rows[others], chunks[others]
                yield from _send(batch, rows + s, chunks, x.shape[1])

    cols = ["id", "v", "aux"] + (["own"] if skip_own else [])
    return queries.select(*cols).mapInArrow(run, QUERY_SCHEMA)


def _part_size(spark, n_probes: int, n_chunks: int) -> int:
    """Queries per part: a bounded number, fewer when there are too few chunks to occupy the cores."""
    cores = spark.sparkContext.defaultParallelism
    if n_chunks >= 4 * cores:
        return SPLIT_QUERIES
    return max(256, min(SPLIT_QUERIES, -(-n_probes // (2 * cores))))


def with_parts(df: DataFrame, table: DataFrame | int) -> DataFrame:
    """Adds ``parts``, the number of parts the queries of a row's chunk are split into."""
    if isinstance(table, int):
        return df.withColumn("parts", F.lit(table))
    joined = df.join(F.broadcast(table), "chunk", "left")  # at most one row per chunk
    return joined.withColumn("parts", F.coalesce("parts", F.lit(1)))


def own_parts(spark, n: int, n_chunks: int) -> int:
    """Parts when every point only visits its own chunk."""
    return -(-min(n, 2 * CHUNK_ROWS) // _part_size(spark, n, n_chunks))


def popular_chunks(queries: DataFrame, n: int, n_chunks: int, plan: Callable) -> tuple[int, DataFrame]:
    """About how many rows ``plan(queries)`` has, and (chunk, parts) of the chunks with many of them.

    Counted on a hash sample of the queries; the counts only size tasks, they change no result.
    """
    spark = queries.sparkSession
    share = min(1.0, ESTIMATE_ROWS / n)
    some = queries.where(f"{draws.uniform(('estimate',), 'id')} < {draws.number(share)}")
    counts = [(r["chunk"], r["count"] / share) for r in plan(some).groupBy("chunk").count().collect()]
    total = max(1, int(sum(c for _, c in counts)))
    size = _part_size(spark, total, n_chunks)
    split = [(chunk, int(-(-c // size))) for chunk, c in counts if c > size]
    return total, spark.createDataFrame(split, "chunk bigint, parts int")


def nearest_cells(points: DataFrame, pivots: np.ndarray, n_probe: int) -> DataFrame:
    """Adds ``cells``: the numbers of the ``n_probe`` nearest pivots, nearest first."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)
    n = min(n_probe, len(pivots))

    def near(batch):
        x = list_matrix(batch.column("v"))
        found = [
            np.argsort(_pivot_distances(x[s:s + QUERY_ROWS], shared.value), axis=1, kind="stable")[:, :n]
            for s in range(0, len(x), QUERY_ROWS)
        ]
        return {"cells": list_array(np.concatenate(found).ravel().astype(np.int64), np.full(len(x), n))}

    return add_columns(points, [], near, {"cells": "array<bigint>"})


def plan_by_lists(queries: DataFrame, cells: Cells, n_probe: int) -> DataFrame:
    """Query rows (id, v, aux) -> one row per chunk of the ``n_probe`` nearest cells."""
    table = queries.sparkSession.createDataFrame(
        [(int(c), chunk) for chunk, c in enumerate(cells.cell)], "cell bigint, chunk bigint"
    )
    rows = nearest_cells(queries.select("id", "v", "aux"), cells.pivots, n_probe)
    rows = rows.select("id", "v", "aux", F.explode("cells").alias("cell"))
    return rows.join(F.broadcast(table), "cell").select("chunk", "id", "v", "aux")


def _stream(batches, work: Callable, decode: Callable | None):
    """Rows sorted by (chunk, part, side): members (side 0) are kept, queries (side 1) stream by.

    ``decode(chunk, codes)`` turns members that travel as short codes into vectors. ``work(ids, vectors)`` gets the
    members of a chunk once and returns what answers a block of its queries.
    """
    key, ids, vecs, answer = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, part = batch.column("chunk").to_numpy(), batch.column("part").to_numpy()
        side, row_id = batch.column("side").to_numpy(), batch.column("id").to_numpy()
        v, aux = batch.column("v"), batch.column("aux")
        turn = (np.diff(chunk) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)
        cuts = [0, *(np.flatnonzero(turn) + 1), len(chunk)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            here = (chunk[lo], part[lo])
            if here != key:
                key, ids, vecs, answer = here, [], [], None
            x = list_matrix(v.slice(lo, hi - lo)) if side[lo] == 0 or ids else None
            if side[lo] == 0:
                ids.append(row_id[lo:hi])
                vecs.append(decode(chunk[lo], x) if decode else x)
            elif ids:
                if answer is None:
                    held = np.concatenate(ids)
                    answer, vecs = work(held, np.concatenate(vecs)), []
                    step = max(1, min(QUERY_ROWS, WORK_ENTRIES // len(held)))
                for s in range(lo, hi, step):
                    e = min(s + step, hi)
                    out = answer(row_id[s:e], x[s - lo:e - lo], list_matrix(aux.slice(s, e - s)))
                    if out is not None:
                        yield out


def probe(
    members: DataFrame, queries: DataFrame, n_probes: int, work: Callable, schema: str,
    decode: Callable | None = None,
) -> DataFrame:
    """Runs ``work(member ids, member vectors)(query ids, vectors, aux)`` for every chunk.

    Both sides carry ``parts``: the members of a chunk are copied to each part, a query goes to one.
    ``n_probes`` estimates the number of query rows.
    """
    cores = members.sparkSession.sparkContext.defaultParallelism
    n_tasks = max(2 * cores, min(100_000, -(-n_probes // SPLIT_QUERIES)))
    left = members.selectExpr(
        "chunk", "explode(sequence(0, parts - 1)) AS part", "0 AS side", "id", "v", "array(0D) AS aux"
    )
    right = queries.selectExpr(
        "chunk", "CAST(pmod(xxhash64(id, 1), parts) AS int) AS part", "1 AS side", "id", "v", "aux"
    )
    laid_out = left.unionByName(right).repartition(n_tasks, "chunk", "part")
    return laid_out.sortWithinPartitions("chunk", "part", "side").mapInArrow(
        lambda batches: _stream(batches, work, decode), schema
    )


def _stream_own(batches, work: Callable):
    """Rows sorted by chunk: the members of each are kept, and then are its queries."""
    def answered(ids, vecs):
        ids, vecs = np.concatenate(ids), np.concatenate(vecs)
        answer, step = work(ids, vecs), max(1, min(QUERY_ROWS, WORK_ENTRIES // len(ids)))
        for s in range(0, len(ids), step):
            some = ids[s:s + step]
            out = answer(some, vecs[s:s + step], np.full((len(some), 1), np.inf))
            if out is not None:
                yield out

    key, ids, vecs = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, row_id, x = batch.column("chunk").to_numpy(), batch.column("id").to_numpy(), list_matrix(batch.column("v"))
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if chunk[lo] != key:
                if ids:
                    yield from answered(ids, vecs)
                key, ids, vecs = chunk[lo], [], []
            ids.append(row_id[lo:hi])
            vecs.append(x[lo:hi])
    if ids:
        yield from answered(ids, vecs)


def probe_own(members: DataFrame, n: int, n_chunks: int, work: Callable) -> DataFrame:
    """Every point against the members of its own chunk, which travel once where a task answers a whole chunk."""
    parts, cores = own_parts(members.sparkSession, n, n_chunks), members.sparkSession.sparkContext.defaultParallelism
    if parts == 1:
        n_tasks = max(2 * cores, min(100_000, -(-n // SPLIT_QUERIES)))
        laid_out = members.select("chunk", "id", "v").repartition(n_tasks, "chunk").sortWithinPartitions("chunk")
        return laid_out.mapInArrow(lambda batches: _stream_own(batches, work), NEAREST_SCHEMA)
    rows = with_parts(members, parts)
    queries = rows.withColumn("aux", F.array(F.lit(float("inf"))))
    return probe(rows, queries, n, work, NEAREST_SCHEMA)


def probe_planned(
    members: DataFrame, queries: DataFrame, n: int, n_chunks: int, plan: Callable, work: Callable,
    schema: str, decode: Callable | None = None,
) -> DataFrame:
    """Every query against the chunks that ``plan`` sends it to."""
    n_probes, popular = popular_chunks(queries, n, n_chunks, plan)
    return probe(
        with_parts(members, popular), with_parts(plan(queries), popular), n_probes, work, schema, decode
    )


class _Bounds:
    """Lower and upper bounds of the squared distances (cosine: distances) of queries to a chunk's members.

    One matrix product in single precision around the chunk's centre, whose error bound is part of the product's last
    two columns: a bound is as tight as its own two vectors allow, and one far member does not loosen the others.
    """

    def __init__(self, m: np.ndarray, metric: str):
        self.m, self.cosine = m, metric == "cosine"
        self.centre = np.zeros(m.shape[1]) if self.cosine else m.mean(axis=0)
        mc = m - self.centre
        self.m2 = (mc * mc).sum(axis=1)
        self.scale = 1.0 if self.cosine else float(np.sqrt(self.m2.max())) or 1.0
        self.m2 /= self.scale ** 2
        self.right = self._right(mc / self.scale, np.float32)

    def _share(self, kind) -> float:
        """Bound of a product's error, as a share of the squared lengths; of 1 and the longest member for cosines."""
        size = max(1.0, float(np.sqrt(self.m2.max()))) if self.cosine else 1.0
        return size * (self.m.shape[1] + 16) * (1.2e-7 if kind is np.float32 else 2.3e-16)

    def _right(self, mc: np.ndarray, kind) -> np.ndarray:
        one, less = np.ones((len(mc), 1)), 1.0 - self._share(kind)
        last = [less * one] if self.cosine else [less * self.m2[:, None], one]
        return np.hstack([mc, *last]).astype(kind).T

    def to(self, q: np.ndarray):
        """(lower bounds as a matrix, what to add for the upper ones by query and by member)."""
        qc = (q - self.centre) / self.scale
        q2 = (qc * qc).sum(axis=1)
        kind = np.float32 if q2.max() < 1e24 else np.float64  # farther ones leave the range of single precision
        share, one = self._share(kind), np.ones((len(q), 1))
        right = self.right if kind is np.float32 else self._right((self.m - self.centre) / self.scale, kind)
        if self.cosine:  # queries have length 1 or 0
            return np.hstack([-qc, one]).astype(kind) @ right, np.full(len(q), 2.0 * share), np.zeros(len(self.m))
        left = np.hstack([-2.0 * qc, one, (1.0 - share) * q2[:, None] - 1e-30]).astype(kind)
        return left @ right, 2.0 * share * q2 + 2e-30, 2.0 * share * self.m2

    def level(self, d: np.ndarray) -> np.ndarray:
        """Distances on the scale of the bounds."""
        return d if self.cosine else (d / self.scale) ** 2


def _above(x: np.ndarray, kind) -> np.ndarray:
    """Values of another precision that are not below."""
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(kind), kind(np.inf))


def _counts(bits: np.ndarray) -> np.ndarray:
    """How many bits are set in each packed row."""
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def _places(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the bits set in packed rows."""
    flat = bits.ravel()
    rows, byte = np.divmod(np.flatnonzero(flat != 0), max(bits.shape[1], 1))
    at, bit = np.nonzero(np.unpackbits(flat[flat != 0][:, None], axis=1))
    return rows[at], byte[at] * 8 + bit


def _measured(q: np.ndarray, m: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    step = max(1, PAIR_ENTRIES // max(q.shape[1], 1))
    parts = [
        pair_distance(q[rows[s:s + step]], m[cols[s:s + step]], metric) for s in range(0, len(rows), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def nearest_work(keep: int, metric: str) -> Callable:
    """The ``keep`` members closest to each query by (distance, id), at most ``aux`` away.

    A matrix product finds the candidates; everything that its error bound cannot rule out is measured
    again from the plain differences, so the answer is exact.
    """

    def work(mid, m):
        bounds = _Bounds(m, metric)

        def answer(qid, q, aux):
            low, by_query, by_member = bounds.to(q)
            cut = bounds.level(aux[:, 0] * (1.0 + 1e-9) + 1e-9) * (1.0 + 1e-9)
            near = np.packbits(low <= _above(cut, low.dtype.type)[:, None], axis=1)
            if len(mid) > keep:
                many = np.flatnonzero(_counts(near) > 4 * keep)
                some = low[many]
                first = np.argpartition(some, keep - 1, axis=1)[:, :keep]
                far = (np.take_along_axis(some, first, axis=1) + by_member[first]).max(axis=1) + by_query[many]
                cut[many] = np.minimum(cut[many], far + np.abs(far) * 1e-6)
                near[many] = np.packbits(some <= _above(cut[many], low.dtype.type)[:, None], axis=1)
            rows, cols = _places(near)
            d = _measured(q, m, rows, cols, metric)
            near = d <= aux[rows, 0] * (1.0 + 1e-9) + 1e-9
            rows, cols, d = rows[near], cols[near], d[near]
            order = np.lexsort((mid[cols], d, rows))
            rows, cols, d = rows[order], cols[order], d[order]
            start = np.searchsorted(rows, np.arange(len(q)))
            best = np.arange(len(rows)) - start[rows] < keep
            if not best.any():
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(qid[rows[best]]), pa.array(mid[cols[best]]), pa.array(d[best])], ["q", "m", "d"]
            )

        return answer

    return work


NEAREST_SCHEMA = "q bigint, m bigint, d double"


def pair_distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row by row, from plain differences or products."""
    if metric == "cosine":
        return 1.0 - (a * b).sum(axis=1)
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _bin_row(low: np.ndarray, begin: np.ndarray, end: np.ndarray, room: np.ndarray, bins: np.ndarray):
    """For ranges of values, how many entries of a row lie below each, and (range, place) of the entries inside.

    One histogram of equal steps serves all ranges; only entries of the steps that a range touches are looked at. ``room``
    and ``bins`` are overwritten: memory taken anew for each row would cost more than the work on it.
    """
    kind, steps = low.dtype.type, min(BINS, len(low) // 2 + 1)
    least, span = low.min(), low.max() - low.min()
    factor = kind(steps) / span if span > 0 else kind(0)
    def step(x, out, to):  # rises with x
        np.multiply(np.subtract(x, least, out=out), factor, out=out)
        to[:] = np.clip(out, 0, steps, out=out)
        return to

    with np.errstate(over="ignore"):
        step(low, room, bins)
        first, last = [step(x, np.empty_like(x), np.empty(len(x), dtype=np.intp)) for x in (begin, end)]
    edges = np.bincount(first, minlength=steps + 2) - np.bincount(last + 1, minlength=steps + 2)
    places = np.flatnonzero((np.cumsum(edges) > 0).take(bins, mode="clip"))
    places = places[np.argsort(low[places])]
    values = low[places]
    before = np.concatenate([[0], np.cumsum(np.bincount(bins, minlength=steps + 1))])
    start, stop = np.searchsorted(values, begin, "left"), np.searchsorted(values, end, "right")
    below = before[first] + start - np.searchsorted(bins[places], first, "left")
    many = np.maximum(stop - start, 0)
    ranges = np.repeat(np.arange(len(begin)), many)
    inside = np.arange(len(ranges)) - np.repeat(np.cumsum(many) - many, many) + start[ranges]
    return below, ranges, places[inside]


def _binned_counts(low: np.ndarray, begin: np.ndarray, end: np.ndarray, q, m, aux, own: np.ndarray, metric: str):
    """Members closer than each of a query's thresholds, where ``begin`` and ``end`` enclose what must be measured.

    ``own`` is the place of a query among the members, or -1.
    """
    counts, rows, slots, cols = np.empty(aux.shape, dtype=np.int64), [], [], []
    room, bins = np.empty_like(low[0]), np.empty(low.shape[1], dtype=np.intp)
    for r in range(len(q)):
        counts[r], slot, col = _bin_row(low[r], begin[r], end[r], room, bins)
        if own[r] >= 0:
            counts[r] -= low[r, own[r]] < begin[r]
            slot, col = slot[col != own[r]], col[col != own[r]]
        rows.append(np.full(len(slot), r))
        slots.append(slot)
        cols.append(col)
    rows, slots, cols = np.concatenate(rows), np.concatenate(slots), np.concatenate(cols)
    closer = _measured(q, m, rows, cols, metric) < aux[rows, slots]
    np.add.at(counts, (rows[closer], slots[closer]), 1)
    return counts


def closer_work(metric: str) -> Callable:
    """For every threshold of a query, how many other members are strictly closer than it.

    Only members whose bounds lie around a threshold are measured again. In large chunks a histogram of the bounds serves
    all thresholds of a query, so many cost little more than one.
    """

    def work(mid, m):
        bounds, order = _Bounds(m, metric), np.argsort(mid, kind="stable")
        ordered = mid[order]

        def answer(qid, q, aux):
            low, by_query, by_member = bounds.to(q)
            kind = low.dtype.type
            at = np.minimum(np.searchsorted(ordered, qid), len(mid) - 1)
            own = np.flatnonzero(ordered[at] == qid)
            wide = by_member.max()
            # one far member would widen the range around each threshold for all
            worth = len(mid) * (aux.shape[1] - BIN_SLOTS) >= BIN_WORK
            if worth and wide <= BIN_SPREAD * np.median(by_member):
                level = bounds.level(aux)
                rim = np.abs(level) * 1e-6 + 1e-30  # of rounding the bounds' sums
                begin, end = level - (by_query[:, None] + wide) - rim, level + rim
                begin, end = np.nextafter(begin.astype(kind), kind(-np.inf)), _above(end, kind)
                mine = np.full(len(q), -1)
                mine[own] = order[at[own]]
                return answers(qid, _binned_counts(low, begin, end, q, m, aux, mine, metric))
            low[own, order[at[own]]] = np.inf
            high = low + by_member.astype(kind)
            counts = np.empty(aux.shape, dtype=np.int64)
            for s in range(aux.shape[1]):
                t = aux[:, s]
                level = bounds.level(t)
                rim = np.abs(level) * 1e-6 + 1e-30  # of rounding the bounds' sums
                surely = np.packbits(high < (level - by_query - rim).astype(kind)[:, None], axis=1)
                maybe = np.packbits(low <= (level + rim).astype(kind)[:, None], axis=1)
                rows, cols = _places(surely ^ maybe)
                closer = _measured(q, m, rows, cols, metric) < t[rows]
                counts[:, s] = _counts(surely) + np.bincount(rows, weights=closer, minlength=len(q)).astype(np.int64)
            return answers(qid, counts)

        return answer

    def answers(qid, counts):
        slots = np.tile(np.arange(counts.shape[1], dtype=np.int64), len(qid))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(qid, counts.shape[1])), pa.array(slots), pa.array(counts.ravel())], ["q", "slot", "n"]
        )

    return work


CLOSER_SCHEMA = "q bigint, slot bigint, n bigint"
