"""Similarity kernel, enclosing-ball radius, loss terms and their derivatives, as SQL text.

The fit builds these once per epoch; one piece of text is one call to the JVM, where the same built up
from Column operators would be hundreds. The two functions on arrays, at the end, are for epochs whose layout is sent
to the tasks; a test holds them to the SQL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ballgraph.functions.draws import number

# Fixed values the results depend on.
TAU_FLOOR = 1e-9      # smallest kernel temperature
RIGHT_SLACK = 1e-9    # slack of the right-angle test
AREA_FLOOR = 1e-9     # floor of the squared triangle area
LOG_FLOOR = 1e-6      # floor inside the cross-entropy logarithms

PHIS = ("student", "exp")


def phi(r: str, kind: str = "student", tau: float = 1.0) -> str:
    if kind == "student":
        return f"(1D / (1D + {r} * {r}))"
    if kind == "exp":
        return f"exp(-{r} / {number(max(float(tau), TAU_FLOOR))})"
    raise ValueError(f"unknown kernel {kind!r}; use one of {PHIS}")


def _sorted_sides(a: str, b: str, c: str) -> tuple[str, str, str]:
    middle = f"greatest(least({a}, {b}), least(greatest({a}, {b}), {c}))"
    return f"least({a}, {b}, {c})", middle, f"greatest({a}, {b}, {c})"


def _area_sq(x: str, y: str, z: str) -> str:
    s = f"(({x} + {y} + {z}) / 2D)"
    return f"({s} * ({s} - {x}) * ({s} - {y}) * ({s} - {z}))"


def _is_obtuse(x: str, y: str, z: str) -> str:
    return f"({z} * {z} >= {x} * {x} + {y} * {y} - {number(RIGHT_SLACK)})"


def _circumradius(x: str, y: str, z: str, area_sq: str) -> str:
    return f"({x} * {y} * {z} / (4D * sqrt(greatest({area_sq}, {number(AREA_FLOOR)}))))"


def ball_radius(a: str, b: str, c: str, soft: bool = True, beta: float = 10.0) -> str:
    """Radius of the smallest ball around a triangle, from its side lengths.

    Acute: the circumradius. Right or obtuse: half the longest side, where ``soft`` replaces the
    maximum by a logsumexp (shifted by the maximum, so large sides do not overflow).
    """
    x, y, z = _sorted_sides(a, b, c)
    bt = number(beta)
    top = f"({z} + ln(exp({bt} * ({x} - {z})) + exp({bt} * ({y} - {z})) + 1D) / {bt})" if soft else z
    sharp = _circumradius(x, y, z, _area_sq(x, y, z))
    return f"(CASE WHEN {_is_obtuse(x, y, z)} THEN {top} / 2D ELSE {sharp} END)"


def with_ball(df: DataFrame, soft: bool = True, beta: float = 10.0) -> DataFrame:
    """Adds the radius ``R_`` and its derivatives ``ra, rb, rc`` by the sides in columns ``a, b, c``.

    Built in stages of plain columns, so that the generated code computes each part once.
    """
    bt = number(beta)
    x, y, z = _sorted_sides("a", "b", "c")
    df = df.selectExpr("*", f"{x} AS _x", f"{y} AS _y", f"{z} AS _z")
    if soft:
        parts = [f"exp({bt} * ({s} - _z)) AS _e{s}" for s in "abc"]
        top = f"(_z + ln(_ea + _eb + _ec) / {bt})"
    else:  # the longest side, the first of equals, has all the weight
        longest = {"a": "a >= b AND a >= c", "b": "a < b AND b >= c", "c": "a < c AND b < c"}
        parts = [f"CASE WHEN {test} THEN 1D ELSE 0D END AS _e{s}" for s, test in longest.items()]
        top = "_z"
    df = df.selectExpr(
        "*", *parts, f"{_is_obtuse('_x', '_y', '_z')} AS _wide", f"{_area_sq('_x', '_y', '_z')} AS _area"
    )
    df = df.selectExpr("*", f"{_circumradius('_x', '_y', '_z', '_area')} AS _circum", "_ea + _eb + _ec AS _total")

    def slope(m: str, p: str, q: str) -> str:
        bend = (f"CASE WHEN _area > {number(AREA_FLOOR)} "
                f"THEN {m} * ({p} * {p} + {q} * {q} - {m} * {m}) / (8D * _area) ELSE 0D END")
        return f"CASE WHEN _wide THEN _e{m} / _total / 2D ELSE _circum * (1D / {m} - {bend}) END AS r{m}"

    return df.selectExpr(
        "*", f"CASE WHEN _wide THEN {top} / 2D ELSE _circum END AS R_",
        slope("a", "b", "c"), slope("b", "a", "c"), slope("c", "a", "b"),
    )


def attract(r: str, kind: str, tau: float) -> tuple[str, str]:
    """-ln(max(q, floor)) and its derivative by r, for triangles that should be small."""
    q, floor = phi(r, kind, tau), number(LOG_FLOOR)
    slope = f"2D * {r} / (1D + {r} * {r})" if kind == "student" else number(1.0 / max(float(tau), TAU_FLOOR))
    return f"(-ln(greatest({q}, {floor})))", f"(CASE WHEN {q} >= {floor} THEN {slope} ELSE 0D END)"


def repel(r: str, kind: str, tau: float) -> tuple[str, str]:
    """-ln(max(1-q, floor)) and its derivative by r, for triangles that should be large."""
    q, floor = phi(r, kind, tau), number(LOG_FLOOR)
    if kind == "student":
        slope = f"-2D / ({r} * (1D + {r} * {r}))"
    else:
        slope = f"-{q} / (1D - {q}) / {number(max(float(tau), TAU_FLOOR))}"
    return f"(-ln(greatest(1D - {q}, {floor})))", f"(CASE WHEN 1D - {q} >= {floor} THEN {slope} ELSE 0D END)"


def ball_arrays(a: np.ndarray, b: np.ndarray, c: np.ndarray, soft: bool, beta: float):
    """As ``with_ball``: the radius, and its derivatives by the three sides."""
    sides = np.stack([a, b, c])
    x, y, z = np.sort(sides, axis=0)
    if soft:
        share = np.exp(beta * (sides - z))
        top = z + np.log(share.sum(axis=0)) / beta
    else:  # the longest side, the first of equals, has all the weight
        share = (np.arange(3)[:, None] == sides.argmax(axis=0)).astype(np.float64)
        top = z
    wide = z * z >= x * x + y * y - RIGHT_SLACK
    s = (x + y + z) / 2.0
    area = s * (s - x) * (s - y) * (s - z)
    circum = x * y * z / (4.0 * np.sqrt(np.maximum(area, AREA_FLOOR)))
    share /= share.sum(axis=0)
    sq = sides * sides
    with np.errstate(divide="ignore", invalid="ignore"):  # of wide triangles, where the other branch counts
        bend = np.where(area > AREA_FLOOR, sides * (sq.sum(axis=0) - 2.0 * sq) / (8.0 * area), 0.0)
        slopes = np.where(wide, share / 2.0, circum * (1.0 / sides - bend))
    return np.where(wide, top / 2.0, circum), slopes


def loss_arrays(r: np.ndarray, positive: np.ndarray, w: np.ndarray, gamma: float, kind: str, tau: float):
    """The weighted ``attract`` of positive triangles and ``repel`` of the others, and its derivative by r."""
    tau, weight = max(float(tau), TAU_FLOOR), np.where(positive, w, gamma * w)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):  # where the floor counts
        if kind == "student":
            q = 1.0 / (1.0 + r * r)
            near, away = 2.0 * r / (1.0 + r * r), -2.0 / (r * (1.0 + r * r))
        else:
            q = np.exp(-r / tau)
            near, away = np.full(len(r), 1.0 / tau), -q / (1.0 - q) / tau
    inside = np.where(positive, q, 1.0 - q)
    slope = np.where(inside >= LOG_FLOOR, np.where(positive, near, away), 0.0)
    return weight * -np.log(np.maximum(inside, LOG_FLOOR)), weight * slope
