"""Sampling of positive and negative triangles with stateless draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.functions.draws import Key, draw, first_ok, modulo, pick
from ballgraph.session import Scratch
from ballgraph.sources.points import dense_codes

SLOTS_PER_TASK = 4_000_000
LIST_BYTES, HELD_BYTES = 160, 64 << 20  # of a list of 10, and of lists that are broadcast
REDRAWS = 4  # pre-drawn values per rejected vertex before the next free id is taken


def next_free(x: str, taken: list[str], n: int) -> str:
    """x, or the first of its successors (mod n) that is not taken."""
    tries = [modulo(f"{x} + {step}", n) for step in range(len(taken) + 1)]
    return first_ok(tries[:-1], lambda c: f"{c} NOT IN ({', '.join(taken)})", tries[-1])


def positive_triplets(candidates: DataFrame, n: int, per_edge: int, seed: int, epoch: int | tuple[int, int],
                      hasher: str = "xxhash64") -> DataFrame:
    """(i, j, k, rep[, w]): one uniform pick from the candidate bag per edge and repeat.

    An edge without candidates takes any other vertex, and has no w. A pair of epochs draws for all from the first to
    the last, with a column ``epoch``.
    """
    key, weighted = ("i", "j", "rep"), "ws" in candidates.columns
    also: list[str] = []
    if isinstance(epoch, tuple):
        candidates = candidates.selectExpr("*", f"explode(sequence({epoch[0]}, {epoch[1]})) AS epoch")
        epoch, also = Key("epoch", *epoch), ["epoch"]
    at = f"pmod({draw((seed, epoch, 'pos'), *key, hasher=hasher)}, size(ks))"
    drawn = candidates.selectExpr("*", f"explode(sequence(0, {per_edge - 1})) AS rep").selectExpr(
        "i", "j", "rep", "ks", *also, *(["ws"] if weighted else []),
        f"CASE WHEN size(ks) > 0 THEN cast({at} AS int) END AS _at",
        f"CASE WHEN size(ks) = 0 THEN {pick(n, (seed, epoch, 'any'), *key, hasher=hasher)} END AS _any",
    )
    return drawn.selectExpr(
        "i", "j", f"coalesce(get(ks, _at), {next_free('_any', ['i', 'j'], n)}) AS k", "rep",
        *(["get(ws, _at) AS w"] if weighted else []), *also,
    )


def negative_counts(n_positive: int, rate: float, uniform_share: float) -> tuple[int, int]:
    """(uniform, semi-local) numbers of negatives; the share is rounded half to even."""
    total = int(n_positive * rate) if rate > 0 else 0
    uniform = int(round(min(max(uniform_share, 0.0), 1.0) * total))
    return uniform, total - uniform


def source_ranks(lists: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, int | None]:
    """Lists (i, js) with the points that have neighbours numbered in order, and their number if not all have."""
    held = lists.where("size(js) > 0").select("i")
    n_sources = held.count()
    if n_sources == n:
        return lists.select("i", "js"), None
    codes = dense_codes(held, "i", "rank", scratch)
    return scratch.save(lists.select("i", "js").join(codes, "i", "left"), "ranked"), n_sources


def negative_triplets(
    lists: DataFrame, n: int, n_uniform: int, n_local: int, seed: int, epoch: int | tuple[int, int],
    exclude_neighbors: bool = False, hasher: str = "xxhash64", n_sources: int | None = None,
) -> DataFrame:
    """(slot, i, j, k). Slots below ``n_uniform`` draw j anywhere outside N(i); the others take an edge.

    Every slot draws its own source point with replacement, so sources are even and no key is hot;
    ``lists`` must be (i, js). Where points have no neighbours, ``lists`` is that of ``source_ranks`` and
    ``n_sources`` its number of sources. A pair of epochs draws for all from the first to the last, with a column
    ``epoch``.
    """
    ranked = n_sources is not None
    first, last, also = 0, 0, []
    if isinstance(epoch, tuple):
        (first, last), epoch, also = epoch, Key("epoch", *epoch), ["epoch"]
    vertex = lambda what, r: pick(n, (seed, epoch, what, r), "slot", hasher=hasher)
    # The first values drawn are columns of their own, so that the tests below only refer to them; few rows need others.
    second, third = [[vertex(what, r) for r in range(REDRAWS)] for what in ("second", "third")]
    first_of = lambda drawn, column, ok, otherwise: first_ok([column], ok, first_ok(drawn[1:], ok, otherwise))
    spark, total = lists.sparkSession, n_uniform + n_local
    every = total * (last - first + 1)
    tasks = max(spark.sparkContext.defaultParallelism, -(-every // SLOTS_PER_TASK))
    slots = spark.range(0, every, 1, tasks)
    if also:
        # a task draws for all epochs, so that the rows of each come from all tasks
        epochs = last - first + 1
        slots = slots.selectExpr(f"id div {epochs} AS slot", f"cast({first} + id % {epochs} AS int) AS epoch")
    else:
        slots = slots.withColumnRenamed("id", "slot")
    source = pick(n_sources if ranked else n, (seed, epoch, "source", 0), "slot", hasher=hasher)
    sources = slots.selectExpr("slot", f"{source} AS rank", *also)
    held = lists.where("size(js) > 0").selectExpr("rank" if ranked else "i AS rank", "i", "js")
    entry = f"pmod({draw((seed, epoch, 'rank', 0), 'slot', hasher=hasher)}, size(js))"
    # lists are hashed where they are, as sorting the slots costs more
    held = F.broadcast(held) if n * LIST_BYTES <= HELD_BYTES else held.hint("shuffle_hash")
    rows = sources.join(held, "rank").selectExpr(
        "slot", "i", "js", *also, f"coalesce(get(js, cast({entry} AS int)), -1L) AS _edge",
        f"CASE WHEN slot < {n_uniform} THEN {second[0]} END AS _second", f"{third[0]} AS _third",
    )
    free = lambda x: f"{x} <> i AND NOT array_contains(js, {x})"
    anywhere = first_of(second, "_second", free, modulo(f"{second[-1]} + 1", n))
    rows = rows.selectExpr(
        "slot", "i", "js", *also, f"CASE WHEN slot < {n_uniform} THEN {anywhere} ELSE _edge END AS j", "_third"
    )
    ok = fits = lambda x: f"{x} <> i AND {x} <> j"
    if exclude_neighbors:
        rows = rows.join(lists.select(F.col("i").alias("j"), F.col("js").alias("js_j")), "j", "left").withColumn(
            "js_j", F.expr("coalesce(js_j, cast(array() as array<bigint>))")
        )
        ok = lambda x: f"{fits(x)} AND NOT array_contains(js, {x}) AND NOT array_contains(js_j, {x})"
    bumped = next_free(f"({third[-1]} + 1)", ["i", "j"], n)
    return rows.selectExpr("slot", "i", "j", f"{first_of(third, '_third', ok, bumped)} AS k", *also)
