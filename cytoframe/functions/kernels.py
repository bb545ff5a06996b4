"""Small numeric kernels for grouped functions: smoothing splines, constrained deconvolution, segmentation.

Each works on the arrays of one group, whose size the caller's grouping bounds (bins of a histogram, windows of one
chromosome of one sample).
"""

from __future__ import annotations

from collections import deque
from math import erf, erfc, sqrt

import numpy as np


def spline_penalty(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q and R of a natural cubic spline with knots x: its roughness is gᵀ Q R⁻¹ Qᵀ g, its inner second derivatives R⁻¹ Qᵀ g."""
    h = np.diff(x)
    n = len(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    return q, r


def smoothing_spline(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Values and second derivatives at x of the smoothing spline whose penalty has the least generalised cross-validation score.

    x strictly rising, w positive weights. One eigenvalue problem gives the score for every penalty; a golden section
    over its logarithm finds the least one, at which the spline is evaluated.
    """
    if len(x) < 3:
        return y.astype(float), np.zeros(len(x)), 0.0
    q, r = spline_penalty(x)
    root = np.sqrt(w)
    k = q @ np.linalg.solve(r, q.T) / root[:, None] / root[None, :]
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    values = np.maximum(values, 0)
    z = vectors.T @ (root * y)

    def score(log: float) -> float:
        shrink = 1 / (1 + np.exp(log) * values)
        return len(x) * float(((1 - shrink) * z) @ ((1 - shrink) * z)) / (len(x) - shrink.sum()) ** 2

    low, high, g = np.log(1e-10), np.log(1e10), (sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = score(a), score(b)
    while high - low > 1e-4:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = score(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = score(b)
    lam = float(np.exp((low + high) / 2))
    fit = vectors @ (z / (1 + lam * values)) / root
    gamma = np.concatenate([[0.0], np.linalg.solve(r, q.T @ fit), [0.0]])
    return fit, gamma, lam


def spline_values(x: np.ndarray, g: np.ndarray, gamma: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and derivative of a natural cubic spline at points; straight lines go on beyond the knots."""
    at = np.asarray(at, float)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    left, right = at - x[i], x[i + 1] - at
    slope = (g[i + 1] - g[i]) / h
    value = (left * g[i + 1] + right * g[i]) / h - left * right * ((1 + left / h) * gamma[i + 1] + (1 + right / h) * gamma[i]) / 6
    derivative = slope + ((3 * left**2 - h**2) * gamma[i + 1] - (3 * right**2 - h**2) * gamma[i]) / (6 * h)
    first = (g[1] - g[0]) / (x[1] - x[0]) - (x[1] - x[0]) * gamma[1] / 6
    last = (g[-1] - g[-2]) / (x[-1] - x[-2]) + (x[-1] - x[-2]) * gamma[-2] / 6
    value = np.where(at < x[0], g[0] + (at - x[0]) * first, np.where(at > x[-1], g[-1] + (at - x[-1]) * last, value))
    return value, np.where(at < x[0], first, np.where(at > x[-1], last, derivative))


class NotConverged(RuntimeError):
    """The constrained minimisation took more rounds than allowed."""

    code = 2


def nonnegative_quadratic(h: np.ndarray, f: np.ndarray, most: int = 1_000, slack: float = 1e-9) -> np.ndarray:
    """The x >= 0 that minimises ½ xᵀ h x - fᵀ x, for positive definite h (one variable freed a round, as in non-negative least squares)."""
    n = len(f)
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(most):
        gradient = f - h @ x
        gradient[free] = -np.inf
        k = int(np.argmax(gradient))
        if free.all() or gradient[k] <= slack * max(1.0, float(np.abs(f).max())):
            return x
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            step = np.zeros(n)
            step[at] = np.linalg.solve(h[np.ix_(at, at)], f[at])
            low = at[step[at] <= 0]
            if not len(low):
                x = step
                break
            share = (x[low] / (x[low] - step[low])).min()
            x = np.maximum(x + share * (step - x), 0)
            free &= x > 1e-15
            x[~free] = 0
            if not free.any():
                break
    raise NotConverged(f"more than {most} rounds")


def _phi(x: np.ndarray) -> np.ndarray:
    return np.array([(1 + erf(v / sqrt(2))) / 2 for v in np.ravel(x)]).reshape(np.shape(x))


def deconvolve(edges: np.ndarray, density: np.ndarray, sigma: float, penalty: float, most: int = 1_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Density before noise: knots, values >= 0 and second derivatives of a natural spline whose blur with sigma fits a histogram's density."""
    mid = (edges[:-1] + edges[1:]) / 2
    width = np.diff(edges)
    kernel = (_phi((edges[1:, None] - mid[None, :]) / sigma) - _phi((edges[:-1, None] - mid[None, :]) / sigma)) * (width[None, :] / width[:, None])
    q, r = spline_penalty(mid)
    rough = q @ np.linalg.solve(r, q.T)
    g = nonnegative_quadratic(kernel.T @ kernel + penalty * (rough + rough.T) / 2 + 1e-10 * np.eye(len(mid)), kernel.T @ density, most)
    return mid, g, np.concatenate([[0.0], np.linalg.solve(r, q.T @ g), [0.0]])


def density_peaks(x: np.ndarray, g: np.ndarray, gamma: np.ndarray, samples: int = 1001, least: float = 0.01) -> list[float]:
    """Places where the spline's derivative falls through zero, largest first; where the value is under ``least`` there are none."""
    at = np.linspace(x[0], x[-1], samples)
    value, slope = spline_values(x, g, gamma, at)
    slope = np.where(value <= least, 0.0, slope)
    hit = np.flatnonzero((slope[:-1] > 0) & (slope[1:] <= 0))
    out = []
    for i in hit:
        fine = np.linspace(at[i], at[i + 1], samples)
        v, _ = spline_values(x, g, gamma, fine)
        out.append(float(fine[int(np.argmax(v))]))
    return sorted(out, reverse=True)


#: Scores that differ by less than this share are equal; of equal ones the first counts.
SAME_SCORE = 1e-9


def _broken(x: np.ndarray, variance: np.ndarray, alpha: float, forced: tuple[int, ...], opens: bool, from_start: bool, scores) -> list[tuple[int, int]]:
    """Segments (first, last) by recursive splitting after the point of the best score.

    Parts wait in a queue; a part is split if its best score's two-sided normal probability is alpha or less. opens: each part that was there before (ended by
    forced points) begins with a segment of one point, but for the one at the start of all; so it comes out where begins and ends of parts go into one list of marks.
    """
    total, spread = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(variance)])
    edges = sorted({-1, len(x) - 1, *(p for p in forced if 0 <= p < len(x))})
    out = []
    for first, last in zip(edges, edges[1:]):
        first += 1
        marks, todo = {last}, deque([(first, last)])
        while todo:
            a, b = todo.popleft()
            at, score = scores(total, spread, x, variance, a, b)
            if not len(at) or np.isnan(score).all():
                continue
            best = np.nanmax(score)
            if erfc(best / sqrt(2)) <= alpha:
                split = int(at[int(np.argmax(score >= best * (1 - SAME_SCORE)))])
                marks.add(split)
                todo += [(a, split), (split + 1, b)]
        if opens and (first or not from_start):
            out.append((first, first))
            first += 1
        for mark in sorted(marks):
            if first <= mark:
                out.append((first, mark))
            first = mark + 1
    return out


def binary_segments(x: np.ndarray, variance: np.ndarray, alpha: float, least: int, forced: tuple[int, ...] = (), *, opens: bool = True, from_start: bool = True) -> list[tuple[int, int]]:
    """Segments by splitting where the means on both sides differ most over the root of the sides' mean variances.

    A part's left side begins with least - 1 points and grows from the point after the next: that one, the last of the first ``least``, stays on the right side throughout.
    """

    def scores(total, spread, x, variance, a, b):
        c = np.arange(a + least, min(b - least + 2, b))  # last points of left sides; something must be left on the right
        held = a + least - 1
        n, m = (c - a).astype(float), (b - c + 1).astype(float)
        side = lambda t, own: (t[held] - t[a] + t[c + 1] - t[held + 1], own[held] + t[b + 1] - t[c + 1])
        if not len(c):
            return c, n
        (left, right), (v, w) = side(total, x), side(spread, variance)
        with np.errstate(divide="ignore", invalid="ignore"):
            return c, np.abs(left / n - right / m) / np.sqrt(np.maximum(v, 0) / n + np.maximum(w, 0) / m)

    return _broken(x, variance, alpha, forced, opens, from_start, scores)


def flank_segments(x: np.ndarray, variance: np.ndarray, alpha: float, least: int, forced: tuple[int, ...] = (), *, opens: bool = True, from_start: bool = True) -> list[tuple[int, int]]:
    """Segments by splitting after a centre whose two flanks of ``least`` points (it is in neither) differ most, by variances of their means.

    The first centre is one further than the left flank needs.
    """

    def scores(total, spread, x, variance, a, b):
        c = np.arange(a + least + 1, b - least + 1)
        if not len(c):
            return c, c.astype(float)
        left, right = total[c] - total[c - least], total[c + 1 + least] - total[c + 1]
        noise = (spread[c] - spread[c - least] + spread[c + 1 + least] - spread[c + 1]) / least**2
        with np.errstate(divide="ignore", invalid="ignore"):
            return c, np.abs(left / least - right / least) / np.sqrt(np.maximum(noise, 0))

    return _broken(x, variance, alpha, forced, opens, from_start, scores)


def fold_runs(tid: np.ndarray, value: np.ndarray, n: np.ndarray, sites: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = 20) -> tuple[list[tuple], np.ndarray]:
    """Segments (chromosome, begin, end, value, sites) of runs of sites in genome order, and for each run the number of its segment (-1: none).

    n: informative sites of a run; sites: all of them; begin: of its first site, end: of its last one; the last run is the genome's last site. A change of value or chromosome
    ends a segment once it has ``least`` informative sites; until then runs go on into the next one, whose value counts, under the first one's chromosome and begin. An end
    moves on with every site but the one that ends a segment, unless it would lie before the begin. What follows the last ended segment, and the last site, belong to none.
    """
    out: list[tuple] = []
    number = np.full(len(tid), -1, np.int64)
    if not len(tid):
        return out, number
    last, first, seen, since = len(tid) - 1, begin[0], 0, 0
    name, level, reach = tid[0], value[0], begin[0]
    for i in range(len(tid)):
        if (value[i] != level or tid[i] != name or i == last) and seen >= least:
            out.append((name, first, reach, level, seen))
            number[since:i] = len(out) - 1
            name, level, first, seen, since = tid[i], value[i], begin[i], 0, i
            moves = sites[i] > 1
        else:
            level, moves = value[i], True
        seen += n[i]
        if moves and end[i] >= first:
            reach = end[i]
    return out, number
