"""Singular values and right singular vectors of one small square matrix by qd transforms.

Householder reflectors make the matrix bidiagonal, dqds finds its singular values to high relative accuracy, and
twisted factorisations of the bidiagonal's Gram matrix give one vector per value. Values too close for that get a
shifted representation of their own, in which they are relatively far apart.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Values nearer than this share of themselves get a representation of their own, so many levels deep.
CLUSTER = 1e-3
DEPTH = 12


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, beta, alpha): (I - beta v v') x = alpha e1."""
    norm = float(np.linalg.norm(x))
    v = x.copy()
    if norm == 0.0 or not np.any(x[1:]):
        return v, 0.0, float(x[0])
    alpha = -norm if x[0] > 0 else norm
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonalise(r: np.ndarray):
    """(a, b, right): diagonal and superdiagonal of B = Q' R P, and the reflectors of P."""
    r = np.array(r, float)
    d = len(r)
    a, b, right = np.zeros(d), np.zeros(max(d - 1, 0)), []
    for k in range(d):
        v, beta, a[k] = _reflector(r[k:, k])
        if beta and k + 1 < d:
            r[k:, k + 1:] -= beta * np.outer(v, v @ r[k:, k + 1:])
        if k + 1 < d:
            v, beta, b[k] = _reflector(r[k, k + 1:])
            if beta:
                r[k + 1:, k + 1:] -= beta * np.outer(r[k + 1:, k + 1:] @ v, v)
                right.append((k + 1, v, beta))
    return a, b, right


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of the bidiagonal with squared diagonal ``q`` and squared superdiagonal ``e``."""
    found: list[float] = []
    work = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while work:
        q, e, sigma = work.pop()
        if len(q) > 1 and q[0] < q[-1]:  # large entries first: small values are found at the end
            q, e = q[::-1], e[::-1]
        guess, sweeps, most = None, 0, 60 * len(q) + 200
        while q:
            n = len(q)
            if n == 1:
                found.append(sigma + q[0])
                break
            tiny = (100 * EPS) ** 2
            if e[-1] <= tiny * (sigma + q[-1]) or e[-1] <= 1e-300:
                found.append(sigma + q.pop())
                e.pop()
                guess = None
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tiny * (sigma + min(q[i], q[i + 1])) or e[i] <= 1e-300), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], sigma))
                q, e, guess = q[cut + 1:], e[cut + 1:], None
                continue
            # a shift below the smallest value: the last 2 x 2 block's, or what the last sweep left of it
            trace, det = q[-2] + e[-1] + q[-1], q[-2] * q[-1]
            low = 2 * det / (trace + max(trace * trace - 4 * det, 0.0) ** 0.5) if trace else 0.0
            shift = low * (1 - 1e-3) if guess is None else min(low, guess) * (1 - 1e-6)
            for s in (shift, 0.75 * shift, 0.25 * shift, 0.0):
                nq, ne, d, least = [0.0] * n, [0.0] * (n - 1), q[0] - s, q[0] - s
                good = d >= 0
                for i in range(n - 1):
                    if not good:
                        break
                    nq[i] = d + e[i]
                    t = q[i + 1] / nq[i] if nq[i] else 0.0
                    ne[i] = e[i] * t
                    d = d * t - s
                    least = min(least, d)
                    good = d >= 0
                if good:
                    nq[-1] = d
                    q, e, sigma, guess = nq, ne, sigma + s, least
                    break
            sweeps += 1
            if sweeps > most:
                raise ArithmeticError("dqds did not converge")
    return sorted(found, reverse=True)


def _stationary(d, l, shift):
    """L+ D+ L+' = L D L' - shift: (D+, L+, s)."""
    n = len(d)
    dp, lp, s = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    s[0] = -shift
    for i in range(n - 1):
        dp[i] = d[i] + s[i]
        if dp[i] == 0.0:
            dp[i] = -EPS * abs(d[i]) or -1e-300
        lp[i] = d[i] * l[i] / dp[i]
        s[i + 1] = lp[i] * l[i] * s[i] - shift
    dp[-1] = d[-1] + s[-1]
    return dp, lp, s


def _below(d, l, x) -> int:
    return sum(v < 0 for v in _stationary(d, l, x)[0])


def _bisect(d, l, nth: int, near: float, spread: float) -> float:
    """The ``nth`` smallest eigenvalue of L D L', near ``near``."""
    low, high = near - spread, near + spread
    while _below(d, l, low) > nth:
        low -= (spread := 2 * spread)
    while _below(d, l, high) <= nth:
        high += (spread := 2 * spread)
    while high - low > 2 * EPS * max(abs(low), abs(high)) and low < (mid := (low + high) / 2) < high:
        low, high = (low, mid) if _below(d, l, mid) > nth else (mid, high)
    return (low + high) / 2


def _twisted(d, l, x: float) -> np.ndarray:
    """The eigenvector of L D L' at ``x`` from the twisted factorisation with the smallest pivot."""
    n = len(d)
    best, size = None, np.inf
    for _ in range(6):
        dp, lp, s = _stationary(d, l, x)
        p, um = [0.0] * n, [0.0] * (n - 1)
        p[-1] = d[-1] - x
        for i in range(n - 2, -1, -1):
            dm = d[i] * l[i] * l[i] + p[i + 1]
            if dm == 0.0:
                dm = EPS * abs(d[i] * l[i] * l[i]) or 1e-300
            t = d[i] / dm
            um[i] = l[i] * t
            p[i] = p[i + 1] * t - x
        pivots = [s[i] + p[i] + x for i in range(n)]
        k = min(range(n), key=lambda i: abs(pivots[i]))
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -lp[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -um[i] * z[i]
        norm = float(np.linalg.norm(z))
        left = abs(pivots[k]) / norm
        if not np.isfinite(norm) or left >= size:
            break
        best, size = z / norm, left
        step = pivots[k] / norm ** 2  # Rayleigh quotient correction
        if abs(step) <= EPS * abs(x):
            break
        x += step
    if best is None:
        raise ArithmeticError("no twisted factorisation at this value")
    return best


def _vectors(d, l, values: dict[int, float], depth: int) -> dict[int, np.ndarray]:
    """{nth: eigenvector} of L D L' for its eigenvalues {nth smallest: value}, whole clusters."""
    out: dict[int, np.ndarray] = {}
    order = sorted(values)
    groups = [[order[0]]]
    for a, b in zip(order, order[1:]):
        if b == a + 1 and values[b] - values[a] <= CLUSTER * max(abs(values[a]), abs(values[b])):
            groups[-1].append(b)
        else:
            groups.append([b])
    for group in groups:
        if len(group) == 1 or depth == DEPTH:
            basis: list[np.ndarray] = []
            for nth in group:
                z = _twisted(d, l, values[nth])
                for _ in range(2):  # only where even the last representation kept values together
                    for y in basis:
                        z = z - y * float(y @ z)
                    norm = float(np.linalg.norm(z))
                    if norm < 1e-8:
                        rng = np.random.default_rng(nth)
                        z, norm = rng.normal(size=len(d)), 1.0
                        for y in basis:
                            z = z - y * float(y @ z)
                        norm = float(np.linalg.norm(z))
                    z = z / norm
                basis.append(z)
                out[nth] = z
            continue
        low, high = values[group[0]], values[group[-1]]
        spread = max(high - low, 4 * EPS * max(abs(low), abs(high)))
        shift = low - spread / 8 if depth % 2 == 0 else high + spread / 8
        dp, lp, _ = _stationary(d, l, shift)
        inner = {k: _bisect(dp, lp, k, values[k] - shift, spread / 16) for k in group}
        out |= _vectors(dp, lp, inner, depth + 1)
    return out


def singular_pairs(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squared singular values of ``r`` and their right vectors as columns; zeros are left out."""
    a, b, right = bidiagonalise(r)
    d = len(a)
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if d == 0 or scale == 0.0:
        return np.zeros(0), np.zeros((d, 0))
    a, b = a / scale, b / scale
    a = np.where(np.abs(a) < EPS * 1e-3, EPS * 1e-3, a)  # far below what counts as zero
    pairs: list[tuple[float, int, np.ndarray]] = []
    cuts = [i + 1 for i in range(d - 1) if abs(b[i]) <= EPS * min(abs(a[i]), abs(a[i + 1]))]
    blocks = list(zip([0, *cuts], [*cuts, d]))
    values = {(lo, nth): v for lo, hi in blocks
              for nth, v in enumerate(reversed(dqds(list(a[lo:hi] ** 2), list(b[lo:hi - 1] ** 2))))}
    zero = max(values.values()) * (d * EPS) ** 2 * 16
    wanted = sorted((v for v in values.values() if v > zero), reverse=True)[:most]
    for lo, hi in blocks:
        own = {nth: v for (at, nth), v in values.items() if at == lo and wanted and v >= wanted[-1] * (1 - 2 * CLUSTER)}
        if not own:
            continue
        aa, bb, signs = a[lo:hi], b[lo:hi - 1], np.ones(hi - lo)
        for i in range(hi - lo - 1):  # B = S1 |B| S2: vectors of |B| times the signs of S2
            signs[i + 1] = np.sign(bb[i]) * np.sign(aa[i]) * signs[i] if bb[i] else signs[i]
        diag, low = list(aa ** 2), list(np.abs(bb) / np.abs(aa[:-1]))
        for nth, z in _vectors(diag, low, own, 0).items():
            whole = np.zeros(d)
            whole[lo:hi] = z * signs
            pairs.append((own[nth], lo, whole))
    pairs.sort(key=lambda x: (-x[0], x[1]))
    pairs = pairs[:len(wanted)]
    vectors = np.stack([p[2] for p in pairs], axis=1) if pairs else np.zeros((d, 0))
    for at, v, beta in reversed(right):
        vectors[at:] -= beta * np.outer(v, v @ vectors[at:])
    return np.array([p[0] for p in pairs]) * scale ** 2, vectors
