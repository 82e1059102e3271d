"""Pieces shared by the operators: words, byte hashes, shared scratch tables, connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballgraph.session import Scratch

#: A broadcast side may hold this many short rows; larger sides are shuffled.
BROADCAST_ROWS = 200_000

#: Word separators: space and \x09-\x0D, as SQL and Java character class.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def arrow_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from lists of column values to lists of column values.

    ``fn`` gets one batch as ``{column: list}`` and yields dictionaries in the order of ``schema``.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for result in fn(batch.to_pydict()):
                arrays = [pa.array(result[f.name], type=f.type) for f in out]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a check of the counted rows; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts laid end to end, each followed by one space.

    ``cuts`` holds where each text begins, and the total length at the end. A-Z are lower-cased. Returns the
    hashes in order and, per text, the index of its first word, with the number of words at the end.
    """
    raw = np.frombuffer(data, np.uint8)
    raw = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)  # every text ends with a space
    powers = np.ones(len(raw) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(raw), _BASE), out=powers[1:])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * powers[:-1], out=sums[1:])
    down = np.ones(len(raw) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(raw), np.uint64(_inverse(int(_BASE)))), out=down[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, cuts)


def laid_out(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts end to end, a space after each, and where each begins."""
    cuts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=cuts[1:])
    return b" ".join(texts) + b" " if texts else b"", cuts


def groups_of(texts: list, most: int) -> list[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``most`` bytes together, at least one text each."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            out.append((begin, i))
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node of undirected edges (a, b).

    Large-star and small-star steps (Kiveris et al. 2014) on written tables until an iteration changes nothing.
    A hub is never collected: each step is a grouped minimum and a join on the node. Nodes without an edge to
    another node are not returned.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{label}-0",
    )
    step, seen = 0, None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            small.select("a", F.col("m").alias("b"))
        ).where("a <> b").distinct()
        step += 1
        after = scratch.save(small, f"{label}-{step}")
        sums = after.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        ).first()
        scratch.drop(f"{label}-{step - 1}")
        now = after
        if seen == tuple(sums):
            break
        seen = tuple(sums)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
