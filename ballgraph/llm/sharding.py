"""Consistent-hash ring with virtual nodes and bounded loads, by DataFrame functions only.

Keys arrive in waves and, in a wave, in ring order. A key takes the first shard clockwise that has room, so a shard is
closed from one point of the arrivals on, and those points decide everything. They are found on counts of (wave, arc): in
rounds, each overfull shard closes where its bound is reached and later keys go on clockwise. A shard that closes before
all others is final, so there are at most as many rounds as shards. Rows then look their places up by their rank in a cell.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballgraph.functions.draws import DRAW_BITS, draw, pick
from ballgraph.session import Scratch

#: Points of a shard on the ring, waves of arrivals, and parts in which a cell's rows are ranked.
VIRTUAL_NODES = 64
WAVES = 16
PARTS = 256
#: Equal pieces of the ring with their own list of points.
SLICES = 1024
#: Cells whose places may be broadcast.
BROADCAST_CELLS = 262_144
#: Bytes that a row counts beyond its text.
ROW_BYTES = 16
#: Equal rows that one array expands.
CHUNK = 1 << 16

_OPEN = (1 << 62, 0)


def _numbers(values) -> str:
    """An array of long constants, short in plans."""
    return f"cast(split('{','.join(map(str, values))}', ',') AS array<bigint>)"


class Ring:
    """Virtual nodes in ring order; arc i ends at point i, and the keys behind the last point belong to arc 0."""

    def __init__(self, spark: SparkSession, shards: int, virtual_nodes: int):
        nodes = spark.range(shards * virtual_nodes).selectExpr(
            f"cast(id % {shards} AS int) AS shard", f"{draw(('ring',), f'id % {shards}', f'id div {shards}', hasher='md5')} AS pos"
        )
        points = sorted((r["pos"], r["shard"]) for r in nodes.collect())  # shards x virtual nodes, both parameters
        self.at, self.owner, self.arcs = [p for p, _ in points], [s for _, s in points], len(points)

    def arc(self, pos: str) -> str:
        """SQL for the arc of a position: points before its slice and points of the slice before it."""
        shift = DRAW_BITS - (SLICES - 1).bit_length()
        before = _numbers(bisect.bisect_left(self.at, k << shift) for k in range(SLICES + 1))
        first, last = (f"element_at({before}, cast(shiftright({pos}, {shift}) AS int) + {k})" for k in (1, 2))
        own = f"slice({_numbers(self.at)}, cast({first} AS int) + 1, cast({last} - {first} AS int))"
        return f"(({first} + size(filter({own}, p -> p < {pos}))) % {self.arcs})"

    def walk(self, arc: str) -> str:
        """SQL for the shards in the order in which a key of an arc meets them."""
        owner = _numbers(self.owner)
        return f"array_distinct(concat(slice({owner}, cast({arc} AS int) + 1, {self.arcs}), slice({owner}, 1, cast({arc} AS int))))"


def _prefix(group: list[str], order: list[str], n: str) -> Column:
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(before), F.lit(0).cast("bigint"))


def keyed_rows(docs: DataFrame, ring: Ring) -> DataFrame:
    """(doc_id, size, text_crc32, m, cell, part, pos): equal rows once, with their number and place in the arrivals."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw).cast("bigint") + ROW_BYTES).alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("m"))
    rows = rows.withColumn("pos", F.expr(draw(("key",), "doc_id", hasher="md5")))
    rows = rows.withColumn("wave", F.expr(pick(WAVES, ("wave",), "doc_id", "size", "text_crc32", hasher="md5")))
    rows = rows.withColumn("part", F.expr(pick(PARTS, ("part",), "doc_id", "size", "text_crc32", hasher="md5")))
    return rows.withColumn("cell", F.col("wave") * ring.arcs + F.expr(ring.arc("pos"))).drop("wave")


def _segments(cuts: list[tuple[int, int]]) -> str:
    """SQL for a cell's places: array of (shard, lo, hi) over the ranks of its ``n`` rows, in the order of its walk."""
    cells, ranks = _numbers(c for c, _ in cuts), _numbers(r for _, r in cuts)
    reach = f"if(element_at({cells}, int(s) + 1) > cell, n, least(n, element_at({ranks}, int(s) + 1)))"
    return (
        f"aggregate(filter(walk, s -> element_at({cells}, int(s) + 1) >= cell), "
        "named_struct('lo', 0L, 'places', cast(array() AS array<struct<shard: bigint, lo: bigint, hi: bigint>>)), "
        f"(a, s) -> if({reach} > a.lo, named_struct('lo', {reach}, 'places', "
        f"concat(a.places, array(named_struct('shard', s, 'lo', a.lo, 'hi', {reach})))), a), a -> a.places)"
    )


def closing_points(cells: DataFrame, capacity: list[int]) -> list[tuple[int, int]]:
    """Per shard (cell, rank in it) from which on it is closed, for written cells (cell, n, walk)."""
    cuts = [_OPEN if c else (-1, 0) for c in capacity]
    bound = F.expr(f"element_at({_numbers(capacity)}, int(shard) + 1)")
    order = Window.partitionBy("shard").orderBy("cell", "lo").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("shard")
    while True:
        places = cells.select("cell", F.expr(f"inline({_segments(cuts)})")).select(
            "*", (F.col("hi") - F.col("lo")).alias("size"), bound.alias("bound")
        )
        over = places.select("*", F.sum("size").over(order).alias("upto"), F.sum("size").over(whole).alias("total")).where(
            "total > bound AND upto >= bound AND upto - size < bound"
        )
        found = over.selectExpr("shard", "cell", "lo + bound - (upto - size) AS rank").collect()  # at most one row a shard
        if not found:
            return cuts
        for r in found:
            cuts[r["shard"]] = (r["cell"], r["rank"])


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Bounds of the shards: ``1 + slack`` times the mean, and without slack the mean rounded so that all are filled."""
    if slack > 0:
        return [-(-int((1 + slack) * rows) // shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign_shards(docs: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a shard and a gapless slot in it for every row.

    ``slack`` is how far above the mean number of rows a shard may be filled; 0 makes the numbers of rows differ by one
    at most (law ``rows``), more slack moves fewer rows when a shard is added. The id is the key; a null id is a key like
    any other, a null text is empty, long texts are only measured. Rows that share an id start at the same point of the
    ring and arrive in different waves; equal rows are counted once and get places of their own. ``grown_shard`` is null:
    where a row goes depends on the rows before it. Other columns are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    ring = Ring(spark, shards, virtual_nodes)
    rows = scratch.save(keyed_rows(docs, ring), "rows")

    parts = rows.groupBy("cell", "part").agg(F.sum("m").alias("n"))
    parts = scratch.save(parts.withColumn("above", _prefix(["cell"], ["part"], "n")), "parts")
    cells = parts.groupBy("cell").agg(F.sum("n").alias("n"))
    cells = scratch.save(cells.withColumn("walk", F.expr(ring.walk(f"cell % {ring.arcs}"))), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    cuts = closing_points(cells, capacities(total, shards, slack))

    places = cells.select("cell", F.expr(f"inline({_segments(cuts)})"))
    places = places.withColumn("n", F.col("hi") - F.col("lo")).withColumn("base", _prefix(["shard"], ["cell", "lo"], "n"))
    places = places.groupBy("cell").agg(F.collect_list(F.struct("lo", "hi", "shard", "base")).alias("places"))
    if ring.arcs * WAVES <= BROADCAST_CELLS:  # places of all cells: at most a point for each and one more for each shard
        places = F.broadcast(places)

    inside = _prefix(["cell", "part"], ["pos", "doc_id", "size", "text_crc32"], "m")
    ranked = rows.withColumn("within", inside).join(parts.select("cell", "part", "above"), ["cell", "part"])
    ranked = ranked.withColumn("first", F.col("above") + F.col("within")).join(places, "cell")
    # many equal rows come out in two steps, so that no array holds them all
    ranked = ranked.withColumn("c", F.explode(F.expr(f"sequence(0L, (m - 1) div {CHUNK})")))
    ranked = ranked.withColumn(
        "rank", F.explode(F.expr(f"sequence(first + c * {CHUNK}, first + least(m, (c + 1) * {CHUNK}) - 1)"))
    ).withColumn("place", F.expr("filter(places, p -> p.lo <= rank AND rank < p.hi)[0]"))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("place.shard").cast("int").alias("shard"),
        (F.col("place.base") + F.col("rank") - F.col("place.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
