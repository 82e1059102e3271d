"""Minimum spanning forests of weighted graphs, by grouped minimum edges and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.operators.linalg import BROADCAST_BYTES
from ballgraph.session import Scratch

KEY_BYTES = 64   # of a component and where it goes, with room for a short group name


def small(rows: int, table: DataFrame) -> DataFrame:
    """``table`` of at most ``rows`` short rows, broadcast if that many fit."""
    return F.broadcast(table) if rows * KEY_BYTES <= BROADCAST_BYTES else table


def _pointers(lightest: DataFrame, scratch: Scratch, tag: str) -> tuple[DataFrame, int]:
    """(g, c, to): the component that each one merges into, and their number.

    Every component goes over its lightest edge. Edges have a strict order, so the only cycles are two components that
    go to each other; the lower one stays. Then everyone goes where its target goes until nobody moves.
    """
    back = lightest.selectExpr("g", "c AS to", "to AS after")
    steps = lightest.join(back, ["g", "to"], "left").selectExpr(
        "g", "c", "CASE WHEN after = c AND c < to THEN c ELSE to END AS to"
    )
    held, turn = scratch.save(steps, f"{tag}-0"), 0
    n = held.count()
    while True:
        turn += 1
        ahead = small(n, held.selectExpr("g", "c AS to", "to AS after"))
        # a target without a pointer has no edge left; with pointers for both ends of an edge there is none
        moved = held.join(ahead, ["g", "to"], "left").selectExpr(
            "g", "c", "coalesce(after, to) AS to", "after IS NOT NULL AND after <> to AS moved"
        )
        held = scratch.save(moved, f"{tag}-{turn}")
        scratch.drop(f"{tag}-{turn - 1}")
        if held.where("moved").isEmpty():
            return held.select("g", "c", "to"), n


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(g, i, j, w), i < j: the minimum spanning forest of every graph ``g`` among the edges (g, i, j, w).

    Ties go by (w, i, j), so the forest is one and the same however the rows lie. Loops, edges without a weight or an
    end and all but the lightest of parallel edges are not used; graphs without edges give no rows. A round takes the
    lightest edge of each component, which map-side minima find, and contracts along them: components at least halve,
    and of the edges between two of them only the lightest goes on. A null ``g`` is a graph of its own.
    """
    scratch = Scratch(edges.sparkSession, "forest")
    known = edges.where("i <> j AND w IS NOT NULL AND NOT isnan(w)").selectExpr(
        "struct(g AS name) AS g", "least(i, j) AS i", "greatest(i, j) AS j", "cast(w AS double) AS w"
    )
    level = known.groupBy("g", F.col("i").alias("a"), F.col("j").alias("b")).agg(F.min("w").alias("w")).selectExpr(
        "g", "a", "b", "struct(w, a AS i, b AS j) AS e"
    )
    level, kept, rounds = scratch.save(level, "edges0"), None, 0
    while not level.isEmpty():
        rounds += 1
        ends = level.selectExpr("g", "a AS c", "struct(e, b AS to) AS x").unionByName(
            level.selectExpr("g", "b AS c", "struct(e, a AS to) AS x")
        )
        lightest = scratch.save(
            ends.groupBy("g", "c").agg(F.min("x").alias("x")).selectExpr("g", "c", "x.e AS e", "x.to AS to"),
            f"lightest{rounds}",
        )
        chosen = lightest.select("g", "e").distinct()
        kept = chosen if kept is None else kept.unionByName(chosen)
        pointers, n = _pointers(lightest.select("g", "c", "to"), scratch, f"pointers{rounds}")
        from_a = small(n, pointers.selectExpr("g", "c AS a", "to AS ra"))
        from_b = small(n, pointers.selectExpr("g", "c AS b", "to AS rb"))
        merged = level.join(from_a, ["g", "a"]).join(from_b, ["g", "b"]).where("ra <> rb")
        merged = merged.groupBy("g", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(
            F.min("e").alias("e")
        )
        level = scratch.save(merged, f"edges{rounds}")
        scratch.drop(f"edges{rounds - 1}")
    if kept is None:
        return known.selectExpr("g.name AS g", "i", "j", "w").limit(0)
    return kept.selectExpr("g.name AS g", "e.i AS i", "e.j AS j", "e.w AS w")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, c): the connected component of every node (id) under the edges (i, j), by the same contraction.

    ``c`` is a node of the component, the same for all. Loops and repeated edges change nothing; a node without an
    edge is its own component; without nodes there are no rows.
    """
    scratch = Scratch(nodes.sparkSession, "components")
    level = edges.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    level = scratch.save(level, "edges0")
    result = scratch.save(nodes.selectExpr("id", "id AS c"), "names0")
    rounds = 0
    while not level.isEmpty():
        rounds += 1
        ends = level.selectExpr("a AS c", "struct(a, b, b AS to) AS x").unionByName(
            level.selectExpr("b AS c", "struct(a, b, a AS to) AS x")
        )
        lightest = ends.groupBy("c").agg(F.min("x").alias("x")).selectExpr("0 AS g", "c", "x.to AS to")
        pointers, n = _pointers(scratch.save(lightest, f"lightest{rounds}"), scratch, f"pointers{rounds}")
        result = scratch.save(
            result.join(small(n, pointers.selectExpr("c", "to")), "c", "left").selectExpr("id", "coalesce(to, c) AS c"),
            f"names{rounds}",
        )
        from_a, from_b = (small(n, pointers.selectExpr(f"c AS {x}", f"to AS r{x}")) for x in "ab")
        merged = level.join(from_a, "a").join(from_b, "b").where("ra <> rb")
        level = scratch.save(
            merged.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"edges{rounds}"
        )
        for old in ("edges", "names"):
            scratch.drop(f"{old}{rounds - 1}")
    return result
