"""Communities of a weighted graph. Edges (i, j, w) are stored in both directions."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ballgraph.functions import draws
from ballgraph.functions.draws import number
from ballgraph.operators.forest import components, small
from ballgraph.session import Scratch

GAIN_FLOOR = 1e-12
#: A refinement ends when at most this share of a level's nodes could still join a part; they stay parts of their own.
OPEN_SHARE = 0.05
#: A level's moves end when two rounds gain less than this share of what the level gained; the next level goes on.
QUIET_SHARE = 0.01


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: share of weight inside the communities of (id, c) minus its expectation."""
    ci = members.select(F.col("id").alias("i"), F.col("c").alias("ci"))
    cj = members.select(F.col("id").alias("j"), F.col("c").alias("cj"))
    inside = F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0))
    per = edges.join(ci, "i").join(cj, "j").groupBy("ci").agg(inside.alias("inside"), F.sum("w").alias("total"))
    whole = F.sum("total")
    return per.agg(
        (F.sum("inside") / whole - F.lit(float(resolution)) * F.sum(F.col("total") * F.col("total")) / (whole * whole))
        .alias("modularity")
    )


class _Level:
    """The graph of one level: ``edges`` (i, j, w, deg) with the degree of i, ``nodes`` (id, deg), their number, the
    weight of the loops; ``rate`` is the expected weight for a unit of both degrees."""

    def __init__(self, edges: DataFrame, whole: float, resolution: float, scratch: Scratch, tag: str):
        self.whole, self.resolution, self.rate = whole, resolution, resolution / whole
        seen = Observation()
        degree = edges.groupBy(F.col("i").alias("id")).agg(
            F.sum("w").alias("deg"), F.sum(F.expr("CASE WHEN i = j THEN w ELSE 0D END")).alias("own")
        ).observe(seen, F.count("*").alias("n"), F.sum("own").alias("loops"))
        self.nodes = scratch.save(degree, f"degree{tag}").select("id", "deg")
        self.n, self.loops = seen.get["n"], seen.get["loops"]
        weighed = edges.where("i <> j").join(self.nodes.selectExpr("id AS i", "deg"), "i")
        self.edges = scratch.save(weighed.select("i", "j", "w", "deg"), f"weighed{tag}")

    def with_totals(self, members: DataFrame, by: str) -> DataFrame:
        """``members`` with the degrees (``total``) and the number (``size``) of all nodes of the same ``by``."""
        totals = members.groupBy(by).agg(F.sum("deg").alias("total"), F.count("*").alias("size"))
        return members.join(small(self.n, totals), by)

    def moved(self, members: DataFrame, turn: str) -> DataFrame:
        """(id, c, home, deg, kept, total): every node whose ``turn`` it is goes to the neighbouring community of
        largest gain, the lowest number on ties. ``kept`` is the weight of its edges into its old one, ``total`` that
        one's degrees. Communities' totals travel with the nodes, so a large community is no key of a join of edges.
        """
        held = self.with_totals(members.select("id", "c", "deg"), "c")
        far = self.edges.join(held.selectExpr("id AS j", "c", "total"), "j")
        far = far.selectExpr("i AS id", "c", "w AS link", "deg", "total", "false AS mine")
        own = held.selectExpr("id", "c", "0D AS link", "deg", "total", "true AS mine")
        options = far.unionByName(own).groupBy("id", "c").agg(
            F.sum("link").alias("link"), F.max("deg").alias("deg"), F.max("total").alias("total"), F.max("mine").alias("mine")
        )
        gain = f"link - {number(self.rate)} * deg * (total - CASE WHEN mine THEN deg ELSE 0D END) AS gain"
        best = options.selectExpr("*", gain).groupBy("id").agg(
            F.expr("max_by(c, struct(gain, -c)) AS to"), F.expr("max(gain) AS best"), F.max("deg").alias("deg"),
            *[F.expr(f"max(CASE WHEN mine THEN {x} END) AS {name}")
              for x, name in (("gain", "stay"), ("link", "kept"), ("c", "home"), ("total", "total"))],
        )
        move = f"{turn} AND best > stay + {number(GAIN_FLOOR)}"
        return best.selectExpr("id", f"CASE WHEN {move} THEN to ELSE home END AS c", "home", "deg", "kept", "total")

    def joined(self, parts: DataFrame, coin: str) -> DataFrame:
        """(id, c, s, deg, open): parts s of the communities c after single nodes joined neighbouring parts.

        A node that is a part alone joins the part inside its community that gains most, if any does. Parts of several
        nodes lose none, and of two single nodes one goes to the other only if their coins (``coin`` of {}) say so;
        so what a node joins stays where it is, and every part is connected. ``open``: it could join a part.
        """
        held = self.with_totals(parts.select("id", "c", "s", "deg"), "s")
        far = held.selectExpr("id AS j", "c AS cj", "s AS to", "total AS total_to", "size AS size_to")
        near = held.where("size = 1").selectExpr("id AS i", "c AS ci")
        links = self.edges.join(near, "i").join(far, "j").where("ci = cj").groupBy(F.col("i").alias("id"), "to").agg(
            F.sum("w").alias("link"), *[F.max(x).alias(x) for x in ("deg", "total_to", "size_to")]
        )
        gain = f"link - {number(self.rate)} * deg * total_to"
        best = links.selectExpr("id", "to", "size_to", f"{gain} AS gain").where(f"gain > {number(GAIN_FLOOR)}")
        best = best.groupBy("id").agg(F.expr("max_by(struct(to, size_to), struct(gain, -to)) AS x"))
        go = f"x.size_to > 1 OR {coin.format('id')} = 1 AND {coin.format('x.to')} = 0"
        return held.join(best, "id", "left").selectExpr(
            "id", "c", f"CASE WHEN x IS NOT NULL AND ({go}) THEN x.to ELSE s END AS s", "deg", "x IS NOT NULL AS open"
        )


def _move(level: _Level, members: DataFrame, scratch: Scratch, depth: int, max_rounds: int, min_gain: float, seed: int):
    """(modularity at the start, the best one, its members (id, c, deg)) of rounds of best moves."""
    best, start, quiet, kept, names = None, None, 0, None, []
    for round_ in range(1, max_rounds + 2):
        turn = f"{draws.pick(2, (seed, depth, round_ // 2), 'id')} = {round_ % 2}"
        seen, name = Observation(), f"members{depth}-{round_}"
        square = F.sum(F.col("deg") * F.col("total")).alias("square")
        moved = level.moved(members, turn).observe(seen, F.sum("kept").alias("inside"), square)
        members = scratch.save(moved, name)
        # the rows tell how good the communities were before they moved
        score = (seen.get["inside"] + level.loops) / level.whole - level.rate * seen.get["square"] / level.whole
        quiet = 0 if best is None or score > best + max(min_gain, QUIET_SHARE * (best - start)) else quiet + 1
        if best is None or score > best:
            start, best, kept = score if start is None else start, score, name
            found = members.selectExpr("id", "home AS c", "deg")
        for old in {*names} - {kept, name}:
            scratch.drop(old)
        names = [kept, name]
        if quiet == 2:
            break
    else:
        warnings.warn(f"level {depth} of the communities stopped after {max_rounds + 1} rounds", stacklevel=3)
    return start, best, found


def _refine(level: _Level, members: DataFrame, scratch: Scratch, depth: int, max_rounds: int, seed: int) -> DataFrame:
    """(id, c, s): connected parts s of the communities of (id, c, deg)."""
    parts = members.selectExpr("id", "c", "id AS s", "deg")
    for round_ in range(1, max_rounds + 1):
        coin = draws.pick(2, (seed, depth, "part", round_), "{}")
        seen, name = Observation(), f"parts{depth}-{round_}"
        after = level.joined(parts, coin).observe(seen, F.count_if("open").alias("open"))
        parts = scratch.save(after, name)
        if round_ > 1:
            scratch.drop(f"parts{depth}-{round_ - 1}")
        if seen.get["open"] <= OPEN_SHARE * level.n:
            return parts.select("id", "c", "s")
    warnings.warn(f"the parts of level {depth} were still joined after {max_rounds} rounds", stacklevel=3)
    return parts.select("id", "c", "s")


def _connected(level: _Level, members: DataFrame) -> DataFrame:
    """(id, c, s): the connected parts of whole communities, each from now on a community of its own."""
    ci, cj = members.selectExpr("id AS i", "c AS ci"), members.selectExpr("id AS j", "c AS cj")
    inside = level.edges.join(ci, "i").join(cj, "j").where("ci = cj").select("i", "j")
    found = components(members.select("id"), inside)
    return found.selectExpr("id", "c", "c AS s")


def communities(edges: DataFrame, resolution: float = 1.0, max_levels: int = 100, max_rounds: int = 100,
                min_gain: float = 1e-4, seed: int = 0, refine: bool = True) -> DataFrame:
    """(id, c): communities by best moves and contraction of the graph, then refined (Traag et al. 2019).

    Moves: all nodes of one half, drawn anew per two rounds, move at once; the other half keeps still, which stops
    neighbours from swapping places. The best round counts, so modularity never falls, and two rounds that gain less
    than ``min_gain``, or than a hundredth of the level's gain, end its moves. Without ``refine`` the communities of a
    level are the nodes of the next until a level gains nothing, as in Louvain's method.

    Refinement starts again from all nodes with those communities, so the answer is never worse. After the moves each
    node starts alone and joins parts inside its community that raise modularity; parts are connected, and they, not
    the communities, are the nodes of the next level. A level without gain contracts whole communities, split into
    their connected parts, which never lowers modularity; when those gain nothing either, they are the answer, so every
    community is connected. The numbers of rounds and levels are only a guard; reaching one gives a warning. An empty
    table gives no rows.
    """
    scratch = Scratch(edges.sparkSession, "communities")
    held = scratch.save(edges.select("i", "j", "w"), "edges0")
    whole = held.agg(F.sum("w")).first()[0]
    result = scratch.save(held.selectExpr("i AS id").distinct().selectExpr("id", "id AS c"), "names0")
    if not whole:
        return result
    members, closed, refining, first = None, True, False, held
    for depth in range(1, max_levels + 1):
        level = _Level(held, whole, resolution, scratch, str(depth))
        current = level.nodes.selectExpr("id", "id AS c", "deg") if closed else level.nodes.join(members, "id")
        start, best, found = _move(level, current, scratch, depth, max_rounds, min_gain, seed)
        gained = best > start + min_gain
        if closed and not gained:
            if refining or not refine:
                break
            members, held, closed, refining = result, first, False, True
            result = members.selectExpr("id", "id AS c")  # from here on the part of each node, at first itself
            continue
        if not refining:
            parts = found.selectExpr("id", "c", "c AS s")
        else:
            parts = _refine(level, found, scratch, depth, max_rounds, seed) if gained else _connected(level, found)
            closed = not gained
        parts = scratch.save(parts, f"lift{depth}")
        members = parts.groupBy(F.col("s").alias("id")).agg(F.min("c").alias("c"))
        result = scratch.save(
            result.join(parts.selectExpr("id AS c", "s"), "c").selectExpr("id", "s AS c"), f"names{depth}"
        )
        ci, cj = parts.selectExpr("id AS i", "s AS ci"), parts.selectExpr("id AS j", "s AS cj")
        held = scratch.save(
            held.join(ci, "i").join(cj, "j").groupBy(F.col("ci").alias("i"), F.col("cj").alias("j"))
            .agg(F.sum("w").alias("w")),
            f"edges{depth}",
        )
        for old in (f"weighed{depth}", f"degree{depth}"):
            scratch.drop(old)
    else:
        warnings.warn(f"the communities stopped after {max_levels} levels", stacklevel=2)
        if refining and not closed:  # the nodes are parts of communities
            result = result.selectExpr("id", "c AS s").join(members.selectExpr("id AS s", "c"), "s").select("id", "c")
    return result
