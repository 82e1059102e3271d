"""Random draws as hashes of keys, as SQL text.

A draw depends only on its constants (seed, epoch, purpose) and key columns, never on partitioning,
task order or retries, so a sample is the same after a repartition or after an executor was lost. The
constants form one string literal: Spark passes strings to generated code by reference, so the code of
one epoch is reused by the next.
"""

from __future__ import annotations

import math

DRAW_BITS = 60


class Key(str):
    """A constant of a draw that is the value of an integer column from ``first`` to ``last``, such as the epoch of rows
    drawn for several epochs."""

    def __new__(cls, column: str, first: int, last: int):
        key = super().__new__(cls, column)
        key.first, key.last = first, last
        return key


def number(x) -> str:
    """A double literal."""
    return f"({float(x)!r}D)"


def draw(consts: tuple, *cols: str, hasher: str = "xxhash64") -> str:
    """Integer in [0, 2**60) from constants and SQL column expressions.

    ``md5`` gives the same integers in any engine that has md5; ``xxhash64`` is the fast default.
    """
    const = "'" + "|".join(str(c) for c in consts) + "'"
    keys = [c for c in consts if isinstance(c, Key)]
    if keys:  # picked from the texts of all values, as making one costs a row more than the hash of it
        key, = keys
        texts = ["'" + "|".join(str(x if c is key else c) for c in consts) + "'" for x in range(key.first, key.last + 1)]
        const = f"get(array({', '.join(texts)}), cast({key} - {key.first} AS int))"
    if hasher == "md5":
        text = ", ".join([const, *(f"cast({c} AS string)" for c in cols)])
        return f"cast(conv(substr(md5(concat_ws('|', {text})), 1, {DRAW_BITS // 4}), 16, 10) AS bigint)"
    if hasher == "xxhash64":
        return f"shiftrightunsigned(xxhash64({', '.join([const, *cols])}), {64 - DRAW_BITS})"
    raise ValueError(f"unknown hasher {hasher!r}")


def modulo(x: str, n: int) -> str:
    """x mod n as a value Spark knows to be present; a nullable join key would be computed a second
    time by the null filter that Spark derives from the join."""
    return f"coalesce(pmod({x}, {int(n)}L), 0L)"


def pick(n: int, consts: tuple, *cols: str, hasher: str = "xxhash64") -> str:
    """Integer in [0, n)."""
    return modulo(draw(consts, *cols, hasher=hasher), n)


def uniform(consts: tuple, *cols: str, hasher: str = "xxhash64") -> str:
    """Double in [0, 1) with 53 random bits."""
    return f"(shiftright({draw(consts, *cols, hasher=hasher)}, {DRAW_BITS - 53}) / {number(1 << 53)})"


def gauss(consts: tuple, *cols: str, hasher: str = "xxhash64") -> str:
    """Standard normal by Box-Muller."""
    u1, u2 = (uniform((*consts, u), *cols, hasher=hasher) for u in ("u1", "u2"))
    return f"(sqrt(-2D * ln(1D - {u1})) * cos({number(2.0 * math.pi)} * {u2}))"


def first_ok(candidates: list[str], ok, otherwise: str) -> str:
    """First candidate that passes ``ok``; rejection sampling over pre-drawn values."""
    tries = ", ".join(f"CASE WHEN {ok(c)} THEN {c} END" for c in candidates)
    return f"coalesce({tries}, {otherwise})"
