"""Small numerics for one tile: a direct solver for nine-point stencils, and a simplex minimiser.

They run inside grouped-map tasks; Spark deals tiles and scenarios to them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def tridiagonal(d: np.ndarray) -> np.ndarray:
    """The matrix with d[1 + di, k] at (k, k + di)."""
    n = d.shape[1]
    m = np.zeros((n, n))
    m.flat[:: n + 1] = d[1]
    m.flat[1 :: n + 1] = d[2, :-1]
    m.flat[n :: n + 1] = d[0, 1:]
    return m


def factor_stencil(c: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """What solves the system of :func:`solve_stencil` for any right side, once its blocks are eliminated.

    Only the inverse of each row's own block is kept: what leads to the rows beside it is tridiagonal."""
    ny, nx = c.shape[2:]
    if nx > ny:
        inner = factor_stencil(c.transpose(1, 0, 3, 2))
        return lambda b: inner(b.T).T
    low, mid, up = np.ascontiguousarray(c.transpose(0, 2, 1, 3))
    linked = [False, *(low[1:].any((1, 2)) & up[:-1].any((1, 2)))]
    inverse = np.empty((ny, nx, nx))
    for row in range(ny):
        centre = tridiagonal(mid[row])
        if linked[row]:
            centre -= tridiagonal(low[row]) @ (inverse[row - 1] @ tridiagonal(up[row - 1]))
        inverse[row] = np.linalg.inv(centre)

    def beside(d: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = d[1] * x
        out[1:] += d[0, 1:] * x[:-1]
        out[:-1] += d[2, :-1] * x[1:]
        return out

    def solve(b: np.ndarray) -> np.ndarray:
        out = np.empty((ny, nx))
        for row in range(ny):
            out[row] = inverse[row] @ (b[row] - beside(low[row], out[row - 1]) if row else b[row])
        for row in range(ny - 2, -1, -1):
            out[row] -= inverse[row] @ beside(up[row], out[row + 1])
        return out

    return solve


def solve_stencil(c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a system that couples each cell of a grid with its eight neighbours.

    c[dj + 1, di + 1, j, i]: coefficient of cell (j + dj, i + di) in the equation of (j, i); b: right
    side. Block elimination by rows (the shorter side becomes the block), so time is
    rows * columns^3. A NaN on the right side spreads to all that depends on it.
    """
    return factor_stencil(c)(b)


def solve_stencils(c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve many systems of one shape at once, as :func:`solve_stencil` does one: c[dj + 1, di + 1, n, j, i] and b[n, j, i] for system n. One
    that can't be solved is an error for all."""
    n, ny, nx = b.shape
    if nx > ny:
        return solve_stencils(c.transpose(1, 0, 2, 4, 3), b.transpose(0, 2, 1)).transpose(0, 2, 1)
    low, mid, up = np.ascontiguousarray(c.transpose(0, 3, 1, 2, 4))
    k = np.arange(nx)
    inverse, x = np.empty((ny, n, nx, nx)), np.empty((ny, n, nx))

    def beside(d: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = d[1] * x
        out[:, 1:] += d[0][:, 1:] * x[:, :-1]
        out[:, :-1] += d[2][:, :-1] * x[:, 1:]
        return out

    def between(d: np.ndarray, m: np.ndarray, e: np.ndarray) -> np.ndarray:
        """tridiagonal(d) @ m @ tridiagonal(e)"""
        left = d[1][:, :, None] * m
        left[:, 1:] += d[0][:, 1:, None] * m[:, :-1]
        left[:, :-1] += d[2][:, :-1, None] * m[:, 1:]
        out = left * e[1][:, None, :]
        out[:, :, :-1] += left[:, :, 1:] * e[0][:, None, 1:]
        out[:, :, 1:] += left[:, :, :-1] * e[2][:, None, :-1]
        return out

    for row in range(ny):
        centre, rest = np.zeros((n, nx, nx)), b[:, row]
        centre[:, k, k], centre[:, k[1:], k[:-1]], centre[:, k[:-1], k[1:]] = mid[row, 1], mid[row, 0, :, 1:], mid[row, 2, :, :-1]
        if row:
            rest = rest - beside(low[row], x[row - 1])
            if low[row].any() and up[row - 1].any():
                centre -= between(low[row], inverse[row - 1], up[row - 1])
        inverse[row] = np.linalg.inv(centre)
        x[row] = (inverse[row] @ rest[:, :, None])[:, :, 0]
    for row in range(ny - 2, -1, -1):
        x[row] -= (inverse[row] @ beside(up[row], x[row + 1])[:, :, None])[:, :, 0]
    return x.transpose(1, 0, 2)


def solve_crosses(c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve many systems of one shape at once, each of which couples the cells of a grid with their four neighbours.

    c[:, n, j, i]: coefficients of the cell above, to the left, itself, to the right and below in system n; b[n, j, i]: right
    sides. Block elimination by rows as in :func:`solve_stencil`; a system that can't be solved is an error for all."""
    n, ny, nx = b.shape
    if nx > ny:
        return solve_crosses(c[[1, 0, 2, 4, 3]].transpose(0, 1, 3, 2), b.transpose(0, 2, 1)).transpose(0, 2, 1)
    up, left, mid, right, down = c.transpose(0, 2, 1, 3)
    k = np.arange(nx)
    inverse, x = np.empty((ny, n, nx, nx)), np.empty((ny, n, nx))
    for row in range(ny):
        centre, rest = np.zeros((n, nx, nx)), b[:, row]
        centre[:, k, k], centre[:, k[1:], k[:-1]], centre[:, k[:-1], k[1:]] = mid[row], left[row, :, 1:], right[row, :, :-1]
        if row:
            centre -= up[row][:, :, None] * inverse[row - 1] * down[row - 1][:, None, :]
            rest = rest - up[row] * x[row - 1]
        inverse[row] = np.linalg.inv(centre)
        x[row] = (inverse[row] @ rest[:, :, None])[:, :, 0]
    for row in range(ny - 2, -1, -1):
        x[row] -= (inverse[row] @ (down[row] * x[row + 1])[:, :, None])[:, :, 0]
    return x.transpose(1, 0, 2)


def residual(c: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """b minus the left side, for checks."""
    ny, nx = b.shape
    wide = np.pad(z, 1)
    return b - sum(c[dj + 1, di + 1] * wide[1 + dj : 1 + dj + ny, 1 + di : 1 + di + nx] for dj in (-1, 0, 1) for di in (-1, 0, 1))


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """The best point that ``search`` finds, and its value."""
    return search(f, start, low, high, rounds, tol)[:2]


def search(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int, tol: float = 1e-4) -> tuple[np.ndarray, float, bool]:
    """Nelder and Mead's simplex method held inside a box: the best point, its value, whether it has converged.

    Values that are not finite count as infinite. A simplex smaller than ``tol`` may have collapsed
    against the box, so a new one is laid around its best point; the search has converged when that one
    shrinks too and moves the best point by less than ten times ``tol``, or its value by less than a
    millionth (or 1e-12 of the value at the start). ``rounds`` holds for all of them. Points met before are not evaluated again."""
    known: dict[tuple, float] = {}

    def g(x: np.ndarray) -> float:
        key = tuple(x)
        if key not in known:
            v = f(x)
            known[key] = v if np.isfinite(v) else np.inf
        return known[key]

    clip = lambda x: np.minimum(high, np.maximum(low, x))

    def simplex(at: np.ndarray) -> list[np.ndarray]:
        points = [clip(np.array(at, float))]
        for k in range(len(at)):
            x = points[0].copy()
            step = 0.1 * (high[k] - low[k])
            x[k] += step if x[k] + step <= high[k] else -step
            points.append(clip(x))
        return points

    points, settled = simplex(start), None
    first = points[0]
    for _ in range(rounds):
        points.sort(key=g)
        if max(np.abs(p - points[0]).max() for p in points[1:]) < tol:
            best = points[0]
            if settled is not None and (np.abs(best - settled).max() < 10 * tol or g(settled) - g(best) <= 1e-6 * abs(g(settled)) + 1e-12 * abs(g(first))):
                return best, g(best), bool(np.isfinite(g(best)))
            points, settled = simplex(best), best
            continue
        centre = np.mean(points[:-1], axis=0)
        mirrored = clip(2 * centre - points[-1])
        if g(mirrored) < g(points[0]):
            far = clip(3 * centre - 2 * points[-1])
            points[-1] = far if g(far) < g(mirrored) else mirrored
        elif g(mirrored) < g(points[-2]):
            points[-1] = mirrored
        else:
            nearer = min((mirrored, points[-1]), key=g)
            inner = clip(centre + 0.5 * (nearer - centre))
            if g(inner) < g(nearer):
                points[-1] = inner
            else:
                points = [points[0], *(clip(points[0] + 0.5 * (p - points[0])) for p in points[1:])]
    points.sort(key=g)
    return points[0], g(points[0]), False


def search_line(f: Callable[[np.ndarray], float], start: float, low: float, high: float, rounds: int, tol: float = 1e-5) -> tuple[np.ndarray, float, bool]:
    """What :func:`search` does, for one number: steps that double lead downhill from the start until values rise or the box ends; between
    the last ones Brent's method (parabolas, golden sections where they don't help) finds the lowest point to ``tol``."""
    known: dict[float, float] = {}

    def g(x: float) -> float:
        if x not in known:
            v = f(np.array([x]))
            known[x] = v if np.isfinite(v) else np.inf
        return known[x]

    x = float(min(high, max(low, start)))
    step = 0.1 * (high - low)
    a, b = max(low, x - step), min(high, x + step)
    while rounds > 0:
        rounds -= 1
        if g(a) < g(x):
            a, x, b = max(low, a - 2 * (x - a)), a, x
        elif g(b) < g(x):
            a, x, b = x, b, min(high, b + 2 * (b - x))
        else:
            break
    second = third = x
    moved = before = 0.0
    for _ in range(rounds):
        middle = (a + b) / 2
        if abs(x - middle) <= 2 * tol - (b - a) / 2:
            return np.array([x]), g(x), bool(np.isfinite(g(x)))
        r, q = (x - second) * (g(x) - g(third)), (x - third) * (g(x) - g(second))
        p, q = (x - third) * q - (x - second) * r, 2 * (q - r)
        p, q = (-p if q > 0 else p), abs(q)
        if abs(before) > tol and np.isfinite(p) and np.isfinite(q) and abs(p) < abs(q * before / 2) and q * (a - x) < p < q * (b - x):
            before, moved = moved, p / q
            if x + moved - a < 2 * tol or b - x - moved < 2 * tol:
                moved = float(np.copysign(tol, middle - x))
        else:
            before = (a if x >= middle else b) - x
            moved = 0.381966 * before
        u = x + (moved if abs(moved) >= tol else float(np.copysign(tol, moved)))
        if g(u) <= g(x):
            a, b = (x, b) if u >= x else (a, x)
            third, second, x = second, x, u
        else:
            a, b = (u, b) if u < x else (a, u)
            if g(u) <= g(second) or second == x:
                third, second = second, u
            elif g(u) <= g(third) or third in (x, second):
                third = u
    return np.array([x]), g(x), False
