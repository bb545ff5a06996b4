"""Numeric kernels against definitions, optimality conditions and small cases worked by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cytoframe.functions import kernels as K
from cytoframe.operators.copynumber import grid
from cytoframe.operators.profile import fold_genome


def test_smoothing_spline_keeps_lines_and_smooths():
    x = np.arange(20.0)
    fit, gamma, lam = K.smoothing_spline(x, 2 * x + 1, np.ones(20))
    assert np.allclose(fit, 2 * x + 1, atol=1e-6) and np.allclose(gamma, 0, atol=1e-6)
    rng = np.random.default_rng(1)
    y = np.sin(x / 4) + rng.normal(0, 0.2, 20)
    fit, gamma, lam = K.smoothing_spline(x, y, np.ones(20))
    assert np.abs(fit - np.sin(x / 4)).mean() < np.abs(y - np.sin(x / 4)).mean()
    value, slope = K.spline_values(x, fit, gamma, x)
    assert np.allclose(value, fit)
    far, _ = K.spline_values(x, fit, gamma, np.array([25.0, 26.0, 27.0]))
    assert far[2] - far[1] == pytest.approx(far[1] - far[0])


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_nonnegative_quadratic_is_optimal(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(12, 6))
    h, f = a.T @ a + 1e-6 * np.eye(6), rng.normal(size=6)
    x = K.nonnegative_quadratic(h, f)
    gradient = h @ x - f
    assert (x >= 0).all() and (gradient >= -1e-6).all() and abs(x @ gradient) < 1e-6


def test_nonnegative_quadratic_reports_too_many_rounds():
    with pytest.raises(K.NotConverged) as e:
        K.nonnegative_quadratic(np.eye(3), np.ones(3), most=1)
    assert e.value.code == 2


def test_deconvolution_finds_two_peaks():
    edges = np.linspace(0, 1.5, 101)
    mid = (edges[1:] + edges[:-1]) / 2
    blur = lambda m: np.exp(-((mid - m) ** 2) / (2 * 0.06**2))
    density = blur(0.9) + 0.7 * blur(0.4)
    density /= density.sum() * 0.015
    x, g, gamma = K.deconvolve(edges, density, 0.05, 1e-6)
    peaks = [p for p in K.density_peaks(x, g, gamma) if K.spline_values(x, g, gamma, np.array([p]))[0][0] > 0.5]
    assert len(peaks) == 2 and peaks[0] == pytest.approx(0.9, abs=0.02) and peaks[1] == pytest.approx(0.4, abs=0.02)
    assert (g >= 0).all()


@pytest.mark.parametrize("split", [K.binary_segments, K.flank_segments])
def test_segments_find_a_step(split):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, 60), rng.normal(2, 0.1, 50)])
    out = split(x, np.full(110, 0.01), 1e-6, 10)
    assert out[0][0] == 0 and out[-1][1] == 109
    assert all(a[1] + 1 == b[0] for a, b in zip(out, out[1:]))
    assert any(abs(a - 60) <= 10 for a, _ in out[1:])
    assert split(np.ones(30), np.full(30, 0.01), 1e-3, 10) == [(0, 29)]
    assert split(np.ones(3), np.ones(3), 1e-3, 10) == [(0, 2)]
    assert split(np.ones(30), np.full(30, 0.01), 1e-3, 10, (9,)) == [(0, 9), (10, 10), (11, 29)]
    assert split(np.ones(30), np.full(30, 0.01), 1e-3, 10, (9,), opens=False) == [(0, 9), (10, 29)]
    assert split(np.ones(30), np.full(30, 0.01), 1e-3, 10, from_start=False) == [(0, 0), (1, 29)]


def stepwise(dat, sig, parts, alpha, least, flanks):
    """Segmentation point by point: sums that gain and lose one point a step, one list of marks at the end."""
    marks = [m for p in parts for m in p]
    queue = list(parts)
    while queue:
        a, b = queue.pop(0)
        best, split = -1.0, None
        if flanks:
            for i in range(1, (b - a) - 2 * least + 1):
                left, right = range(a + i, a + least + i), range(a + least + i + 1, a + 2 * least + i + 1)
                noise = sum(sig[k] for k in left) / least**2 + sum(sig[k] for k in right) / least**2
                score = abs(sum(dat[k] for k in left) / least - sum(dat[k] for k in right) / least) / math.sqrt(noise)
                if score > best * (1 + 1e-9):
                    best, split = score, a + least + i
        else:
            left, right = list(range(a, min(a + least - 1, b + 1))), list(range(a + least - 1, b + 1))
            for i in range((b - a + 1) - 2 * least + 1):
                left.append(a + least + i)
                right.remove(a + least + i)
                score = abs(sum(dat[k] for k in left) / len(left) - sum(dat[k] for k in right) / len(right)) / math.sqrt(sum(sig[k] for k in left) / len(left) + sum(sig[k] for k in right) / len(right))
                if score > best * (1 + 1e-9):
                    best, split = score, a + least + i
        if split is not None and math.erfc(best / math.sqrt(2)) <= alpha:
            marks.append(split)
            queue += [(a, split), (split + 1, b)]
    marks.sort()
    out = []
    for v, after in zip(marks, [*marks[1:], None]):
        if v != len(dat) - 1:
            out.append((0 if v == 0 else v + 1, after))
    return [x for x in out if x[0] <= x[1]]


@pytest.mark.parametrize("flanks", [False, True])
def test_segments_equal_the_stepwise_loop(flanks):
    rng = np.random.default_rng(8)
    for k in range(60):
        n, least = int(rng.integers(1, 70)), int(rng.integers(2, 7))
        x = np.repeat(rng.normal(0, 1, 8), 9)[:n] + rng.normal(0, 0.2, n)
        sig = rng.uniform(0.01, 0.2, n)
        cut = tuple(sorted({int(c) for c in rng.integers(1, n + 1, int(rng.integers(0, 3))) if c < n}))  # a part of the first point alone has no mark of its own
        edges = sorted({-1, n - 1, *cut})
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:])]
        kernel = K.flank_segments if flanks else K.binary_segments
        assert kernel(x, sig, 0.05, least, cut) == stepwise(x, sig, parts, 0.05, least, flanks), k


def site_by_site(tid, value, ok, begin, end, least):
    """Segments of sites in order, and the segment of each site."""
    out, number = [], [-1] * len(tid)
    seen, first, level, name, reach, since = 0, begin[0], value[0], tid[0], begin[0], 0
    for k in range(len(tid)):
        if (level != value[k] or k == len(tid) - 1 or name != tid[k]) and seen >= least:
            out.append((name, first, reach, level, seen))
            number[since:k] = [len(out) - 1] * (k - since)
            seen, level, name, first, since = 0, value[k], tid[k], begin[k], k
        else:
            if end[k] - first >= 0:
                reach = end[k]
            level = value[k]
        seen += ok[k]
    return out, number


def test_folded_runs_equal_sites_one_by_one():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, least = int(rng.integers(1, 120)), 5
        tid = np.sort(rng.integers(0, 4, n))
        begin = np.concatenate([np.sort(rng.integers(0, 50, (tid == t).sum())) * 10 for t in range(4)])
        value, ok = (begin // 70 % 3).astype(float), rng.integers(0, 2, n)
        want, sites = site_by_site(tid, value, ok, begin, begin + 9, least)
        before = np.array([min(ok[:k][tid[:k] == tid[k]].sum(), least) for k in range(n)])
        final = np.arange(n) == n - 1
        new = np.concatenate([[True], (tid[1:] != tid[:-1]) | (value[1:] != value[:-1]) | (before[1:] != before[:-1]) | (final[1:] != final[:-1])])
        run = np.cumsum(new) - 1
        at, ends = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], n) - 1
        got, number = K.fold_runs(tid[at], value[at], np.bincount(run, ok).astype(int), np.bincount(run), begin[at], begin[ends] + 9, least)
        assert got == want and number[run].tolist() == sites
    assert K.fold_runs(*[np.zeros(0)] * 6)[0] == []


def test_windows_close_by_length_and_reads():
    tid, size, reads = np.array([0, 0, 0, 0, 0, 1, 1, 1, 1, 2]), np.full(10, 5.0), np.array([1.0, 1, 3, 9, 4, 7, 9, 0, 2, 6])
    got = fold_genome(tid, size, reads, 10, 2)
    # the open window 2 closes at chromosome 1, whose first partition stays in it while its reads count to window 3
    assert got.window.tolist() == [0, 0, 1, 1, 2, 2, 3, 4, 4, 5] and got.counted.tolist() == [0, 0, 1, 1, 2, 3, 3, 4, 4, 5]
    # its length runs on; no window is open at chromosome 2, so that partition's GC doesn't count
    assert got.so_far.tolist() == [5, 10, 5, 10, 5, 10, 15, 5, 10, 5]
    assert got.with_gc.tolist() == [True] * 9 + [False] and np.flatnonzero(got.ends).tolist() == [5, 9]


def test_grid_ends_where_repeated_addition_ends():
    purities = grid(0.2, 1.0, 0.01)
    assert len(purities) == 80 and purities[-1] < 1 and len(grid(1.5, 4.5, 0.01)) == 301


def test_erf_matches(spark):
    from pyspark.sql import functions as F

    from cytoframe.functions.columns import erf, lgamma, six_digits, theta_corr

    rows = spark.range(-400, 401).select((F.col("id") / 80.0).alias("x")).select("x", erf(F.col("x")).alias("e"), lgamma(F.abs("x") + 1).alias("g"), six_digits(F.col("x") * 1234.56789).alias("s"), theta_corr(F.abs("x"), F.lit(0.1)).alias("t")).collect()
    for r in rows:
        assert abs(r.e - math.erf(r.x)) < 1e-14 and abs(r.g - math.lgamma(abs(r.x) + 1)) < 1e-10
        assert r.s == pytest.approx(float(f"{r.x * 1234.56789:.6g}"), rel=1e-12)
