"""Operators without SQL: mismatch strings, purity from mutations."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from cytoframe.operators import copynumber, pileup, reads
from cytoframe.plans import model_queries


def test_mismatch_strings(spark):
    def rows(read, ops):
        return [(read, i, *x) for i, x in enumerate(ops)]

    data = rows("a", [("M", "A", "A"), ("M", "C", "C"), ("M", "G", "T"), ("M", "G", "C"), ("D", None, "A"), ("D", None, "C"), ("M", "T", "G"), ("M", "T", "T")])
    data += rows("b", [("M", "A", "A")] * 3) + rows("c", [("M", "A", "C"), ("N", None, "C"), ("M", "A", "A"), ("D", None, "T"), ("M", "A", "A")])
    df = spark.createDataFrame(data, "read string, ref_pos int, op string, base string, ref string")
    got = {r.read: (r.nm, r.md) for r in pileup.edit_distances(df, ["read"]).collect()}
    assert got == {"a": (5, "2T0C0^AC0G1"), "b": (0, "3"), "c": (2, "0C1^T1")}


def test_purity_from_mutations(spark):
    rng = np.random.default_rng(1)
    segments = spark.createDataFrame([(i, 1e6, 2.0, 0.01, 200) for i in range(4)], "seg_id bigint, length double, cn double, theta double, n_snps bigint")
    af = rng.binomial(200, 0.3, 400) / 200.0  # one copy of two in 0.6 of the cells
    mutations = spark.createDataFrame([(k, k % 4, float(a), 200) for k, a in enumerate(af)], "mut_key bigint, seg_id bigint, af_obs double, coverage bigint")
    purity, ploidy = copynumber.refine_purity(segments, mutations, sigma=0.02, rounds=2)
    assert purity == pytest.approx(0.6, abs=0.06) and ploidy == 2.0


def brute_fit(segments, purity, ploidy, sigma):
    """l_bi and l_cn of one point of the grid, pair by pair of alleles."""

    def seen(x):
        return x * math.erf(x / (2 * math.sqrt(2) * sigma)) + math.sqrt(8 / math.pi) * sigma * math.exp(-x * x / (8 * sigma * sigma))

    l_bi = l_cn = 0.0
    for cn, theta, s in segments:
        raw = (cn - 2 * (1 - purity)) * ploidy / (2 * purity)
        icn = int(raw + 0.5)
        icn = 49 if icn > 50 else max(icn, 0)
        error = min(abs(theta - seen(purity * (icn - 2 * b) / (2 + purity * (icn - 2)) if icn else 0.0)) for b in range(icn // 2 + 1))
        l_bi += error**2 / (2 * s * s)
        l_cn += (raw - icn) ** 2 / (2 * s * s)
    return l_bi, l_cn


def test_fit_and_profile_on_the_whole_grid(spark):
    few = [(2.0, 0.05, 0.02), (2.7, 0.3, 0.03), (1.3, 0.62, 0.02), (3.4, 0.21, 0.04)]
    rows = spark.createDataFrame([(0, k, 1e5, *x, 9) for k, x in enumerate(few)], "tid int, seg_id bigint, length double, cn double, theta double, theta_sigma double, n_snps bigint")
    fit = copynumber.fit_grid(rows, model_queries.PURITIES, model_queries.PLOIDIES, 0.04)
    got = {(r.purity, r.ploidy): (r.l_bi, r.l_cn) for r in fit.collect()}
    assert len(got) == 80 * 301
    some = [x for i, x in enumerate(sorted(got)) if i % 11 == 0]
    assert all(got[x] == pytest.approx(brute_fit(few, *x, 0.04), rel=1e-6, abs=1e-6) for x in some)


def test_fit_by_hand(spark):
    # one segment of three copies at purity 1: A = 2, B = 1 has an imbalance of 1/3
    row = (0, 0, 1e5, 3.0, 1 / 3, 0.015, 9)
    rows = spark.createDataFrame([row], "tid int, seg_id bigint, length double, cn double, theta double, theta_sigma double, n_snps bigint")
    one = copynumber.fit_grid(rows, [1.0], [2.0], 1e-6).first()
    assert one.l_bi == pytest.approx(0, abs=1e-9) and one.l_cn == 0 and one.mean_copies == 3 and one.scale == 1
    state = copynumber.allele_states(rows.selectExpr("*", "1.0D as purity", "1.0D as scale"), ["seg_id"], 1e-6).first()
    assert (state.a, state.b, state.icn) == (2, 1, 3)
    none = rows.selectExpr("tid", "seg_id", "0.0D as cn", "theta", "theta_sigma", "1 as n_snps", "1.0D as purity", "1.0D as scale")
    state = copynumber.allele_states(none, ["seg_id"], 0.02).first()
    assert (state.a, state.b) == (0, 0) and state.theta_exp == pytest.approx(math.sqrt(8 / math.pi) * 0.02)
    few = rows.selectExpr("tid", "seg_id", "cn", "theta", "theta_sigma", "4 as n_snps", "1.0D as purity", "1.0D as scale")
    state = copynumber.allele_states(few, ["seg_id"], 0.02).first()
    assert (state.a, state.b, state.theta_exp, state.error) == (-1, -1, -1, None)


def test_two_clones_by_hand(spark):
    # purity 1, half of the cells with A = 2, B = 1 and half with A = 1, B = 1: 2.5 copies, imbalance 0.5 / 2.5
    rows = spark.createDataFrame([(0, 2.5, 0.2, 2, 1, True), (1, 2.5, 0.2, 2, 1, False), (2, 0.5, 0.9, 2, 1, True)], "k int, cn double, theta double, a bigint, b bigint, is_subclonal boolean")
    out = {r.k: r for r in copynumber.two_clones(rows.selectExpr("*", "1.0D as purity", "1.0D as scale"), 1e-6).collect()}
    assert (out[0].a1, out[0].b1, out[0].a2, out[0].b2) == (2, 1, 1, 1) and out[0].tau1 == pytest.approx(0.5, abs=1e-4)
    assert not out[0].is_inconsistent and out[1].a1 is None and not out[1].is_inconsistent and out[2].is_inconsistent


def test_variance_of_sparse_bins(spark):
    rows = spark.createDataFrame([(0.105, 1.0)] * 6 + [(0.505, 100.0)] * 2, "gc double, residual double")
    assert {r.gc_bin: r.variance for r in copynumber.gc_variance(rows, "residual").collect()} == {10: 1.0, 50: 1.0}


def test_certain_fraction(spark):
    ccf, p = copynumber.cell_fraction(*[F.col(c) for c in ("af", "af_exp", "dp")])
    row = spark.createDataFrame([(1.0, 0.5, 30)], "af double, af_exp double, dp int").select(ccf.alias("ccf"), p.alias("p")).first()
    assert (row.ccf, row.p) == (2.0, 1.0)


def test_lone_reads_and_mates(spark):
    # a paired read alone, a pair on two strands, the last read by name alone
    data = [("a", 73 - 8, 0, 100, 109, 5, 50, 7), ("b", 1 + 2 + 64, 0, 100, 109, 0, 0, 0), ("b", 1 + 2 + 16 + 128, 0, 140, 149, 0, 0, 0), ("c", 1 + 4 + 64, 0, 1, 1, 9, 9, 9)]
    df = spark.createDataFrame(data, "qname string, flag int, tid int, pos bigint, ref_end bigint, mtid int, mpos bigint, isize bigint").withColumn("n", F.monotonically_increasing_id())
    got = [(r.qname, r.flag, r.mtid, r.mpos, r.isize) for r in reads.fix_mates(df, order=["n"]).orderBy("qname", "n").collect()]
    assert got == [("a", 73, -1, 0, 0), ("b", 67 + 32, 0, 140, 50), ("b", 147, 0, 100, -50), ("c", 69, 9, 9, 9)]
