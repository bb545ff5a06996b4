"""Queries of the copy-number model, and the same in DuckDB SQL. Doubles are rounded alike on both sides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.functions import columns as C
from cytoframe.functions import kernels
from cytoframe.operators import copynumber as M
from cytoframe.operators import profile as profile_
from cytoframe.operators.intervals import islands
from cytoframe.plans.adapters import mutations, partitions, segments, snps, with_views
from cytoframe.session import written

DIGITS = 6


def _rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def special_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = mutations(spark, d).withColumn("x", (F.col("mut_key") % 800) / 100.0 - 4)
    return rows.select("mut_key", F.round(C.erf(F.col("x")), 12).alias("erf_x"), F.round(C.lgamma(F.abs(F.col("x")) + 1), 9).alias("lgamma_x"), F.round(C.phred_error(F.col("dp")), 15).alias("error"), C.truncate_half(F.col("x") * 7).alias("cut"))


SPECIAL_FUNCTIONS = with_views("mutations") + ", t as (select *, (mut_key % 800) / cast(100 as double) - 4 as x from mutations) select mut_key, round(" + C.erf_sql("x") + ", 12) as erf_x, round(lgamma(abs(x) + 1), 9) as lgamma_x, round(pow(cast(10 as double), -dp / cast(10 as double)), 15) as error, cast(trunc(x * 7 + 0.5) as bigint) as cut from t"


def informative_sites(spark: SparkSession, d: str) -> DataFrame:
    return M.heterozygous_sites(snps(spark, d))


_HET = """ t_a + t_b >= 15 and n_a + n_b >= 15 and pow(cast(0.5 as double) - abs(t_a / cast(t_a + t_b as double) - cast(0.5 as double)), 2) + pow(cast(0.5 as double) - abs(n_a / cast(n_a + n_b as double) - cast(0.5 as double)), 2) >= cast(0.0225 as double)"""
INFORMATIVE_SITES = with_views("snps") + f" select * from snps where {_HET}"


def _imbalance(spark: SparkSession, d: str) -> DataFrame:
    return M.imbalance_by(snps(spark, d).withColumn("seg_id", F.col("tid") * 10 + F.floor((F.col("pos") - 1) / 100_000)), ["seg_id"])


_THETA = """, x as (select cast(tid * 10 + (pos - 1) // 100000 as bigint) as seg_id, 4 * pow(t_a / cast(t_a + t_b as double) - cast(0.5 as double), 2) as xi from snps),
 m as (select seg_id, sqrt(median(xi)) as theta, count(*) as n_snps from x group by seg_id),
 theta as (select seg_id, n_snps, theta, greatest(sqrt(sum(pow(sqrt(xi) - theta, 2))) / n_snps, cast(0.015 as double)) as theta_sigma from x join m using (seg_id) group by seg_id, n_snps, theta)"""


def imbalance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_imbalance(spark, d), "theta", "theta_sigma", digits=9)


IMBALANCE = with_views("snps") + _THETA + " select seg_id, n_snps, round(theta, 9) as theta, round(theta_sigma, 9) as theta_sigma from theta"


#: The sample's noise and fit that queries of single steps work at.
SIGMA, PURITY, SCALE = 0.04, 0.7, 1.4285


def folded_sigma(spark: SparkSession, d: str) -> DataFrame:
    from cytoframe.plans.interval_queries import _counts

    ratio = M.genome_totals(_counts(spark, d)).first()["ratio_n_t"]  # one row
    return _rounded(M.folded_sigma(snps(spark, d), ["tid"], ratio), "sigma")


FOLDED_SIGMA = (
    with_views("snps", "reads")
    + """, a as (select cast(count(*) filter (sample = 'N') as double) / count(*) filter (sample = 'T') as a from reads where mapq > 0 and pos % 53 <> 0)
 select tid, round(sqrt(median(4 * pow(n_a / cast(n_a + n_b as double) - cast(0.5 as double), 2)) * (select a from a) * cast(3.141593 as double) / 8), 6) as sigma from snps
 where t_a + t_b >= 15 and n_a + n_b >= 15 and pow(cast(0.5 as double) - abs(n_a / cast(n_a + n_b as double) - cast(0.5 as double)), 2) >= cast(0.0225 as double) group by tid"""
)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments with a depth near their copies and the imbalance of their sites."""
    near = segments(spark).withColumn("cn", F.col("icn") * 0.7 + 0.6 + ((F.col("seg_id") * 13) % 11 - 5) / 100.0).withColumn("length", (F.col("s_end") - F.col("s_start")).cast("double"))
    return near.join(_imbalance(spark, d), "seg_id")


_SEGMENTS = _THETA + ", g as (select s.*, s.icn * cast(0.7 as double) + cast(0.6 as double) + ((s.seg_id * 13) % 11 - 5) / cast(100 as double) as cn, cast(s_end - s_start as double) as length, n_snps, theta, theta_sigma from segments s join theta using (seg_id))"


def _at_fit(rows: DataFrame) -> DataFrame:
    return rows.withColumn("purity", F.lit(PURITY)).withColumn("scale", F.lit(SCALE))


def allele_states(spark: SparkSession, d: str) -> DataFrame:
    out = M.allele_states(_at_fit(_segments(spark, d).drop("icn")), ["seg_id"], SIGMA)
    return out.select("seg_id", "icn", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), *[F.round(c, DIGITS).alias(c) for c in ("theta_exp", "error", "ls")])


_D = lambda x: f"cast({x!r} as double)"
_TC = lambda x: C.theta_corr_sql(x, _D(SIGMA))
_RAW = f"((cn - 2 * (1 - {_D(PURITY)})) * {_D(SCALE)})"
_WHOLE = lambda raw: f"(case when cast(trunc({raw} + cast(0.5 as double)) as bigint) > 50 then 49 when {raw} < 0 then 0 else cast(trunc({raw} + cast(0.5 as double)) as bigint) end)"
_PAIR = lambda b: f"(case when icn = 0 then cast(0 as double) else {_D(PURITY)} * (icn - 2 * ({b})) / (2 + {_D(PURITY)} * (icn - 2)) end)"
_STATES = lambda key, source: (
    f""", c0 as (select *, {_WHOLE(_RAW)} as whole from {source}), c1 as (select * exclude (whole), whole as icn, unnest(range(whole // 2 + 1)) as b from c0),
 c2 as (select *, icn - b as a, {_TC(_PAIR("b"))} as te, {_TC(_PAIR("b + 1"))} as after, {_TC("cast(0 as double)")} as bare from c1),
 c3 as (select *, abs(theta - te) as e, row_number() over (partition by {key} order by round(abs(theta - te), 9), b) as k,
   min(case when icn = 1 then abs(te - bare) when b < icn // 2 then abs(theta - te - after) end) over (partition by {key}) as step from c2),
 st as (select * exclude (a, b, te, e, after, bare, step, k), case when icn = 0 or n_snps >= 5 then a else -1 end as a, case when icn = 0 or n_snps >= 5 then b else -1 end as b,
   case when icn = 0 or n_snps >= 5 then te else -1 end as theta_exp, case when icn = 0 or n_snps >= 5 then e end as error,
   case when icn > 0 and n_snps >= 5 then 1 / case when icn = 1 then step else least(step, 1) end end as ls from c3 where k = 1)"""
)
ALLELE_STATES = with_views("snps", "segments") + _SEGMENTS.replace("s.*, s.icn *", "s.* exclude (icn), s.icn *") + _STATES("seg_id", "g") + " select seg_id, icn, a, b, round(theta_exp, 6) as theta_exp, round(error, 6) as error, round(ls, 6) as ls from st"


def _case_rows(spark: SparkSession, d: str) -> DataFrame:
    """Depth, imbalance and sites of every kind, one segment for each mutation."""
    key = F.col("mut_key")
    return _at_fit(mutations(spark, d).select("mut_key", "tid", "af", "dp", "ref", "alt", (key * 37 % 500 / 100.0).alias("cn"), (key * 53 % 1000 / 1000.0).alias("theta"), (0.015 + key % 7 / 200.0).alias("theta_sigma"), (key % 50 + 3).alias("n_snps"), (key * 10).alias("s_start"), (key * 10 + key % 900).alias("s_end")))


def _clones(spark: SparkSession, d: str) -> DataFrame:
    rows = _case_rows(spark, d)
    states = M.allele_states(rows, ["mut_key"], SIGMA).select("mut_key", "icn", "a", "b", "theta_exp")
    return M.two_clones(M.subclonal_test(rows.join(states, "mut_key")), SIGMA)


_CASES = """, cases as (select mut_key, tid, af, dp, ref, alt, mut_key * 37 % 500 / cast(100 as double) as cn, mut_key * 53 % 1000 / cast(1000 as double) as theta, cast(0.015 as double) + mut_key % 7 / cast(200 as double) as theta_sigma, mut_key % 50 + 3 as n_snps, mut_key * 10 as s_start, mut_key * 10 + mut_key % 900 as s_end from mutations)"""
_TEST = f"""(1 - {C.erf_sql("(abs(theta - theta_exp) / (sqrt(cast(2 as double)) * theta_sigma))")})"""
_TESTED = f""", pp as (select *, case when n_snps >= 5 and theta_exp >= 0 then {_TEST} else 1 end as p0 from st),
 sub as (select * exclude (p0), case when p0 < 0.001 and ((a = b and theta < theta_exp) or (b = 0 and theta > theta_exp)) then 1 else p0 end as p_subclonal from pp)"""
_CASE_TESTED = with_views("mutations").replace("with ", "with recursive ", 1) + _CASES + _STATES("mut_key", "cases") + _TESTED


def subclonal(spark: SparkSession, d: str) -> DataFrame:
    return _clones(spark, d).select("mut_key", "is_subclonal", F.round("p_subclonal", DIGITS).alias("p_subclonal"))


SUBCLONAL = _CASE_TESTED + " select mut_key, p_subclonal < 0.001 as is_subclonal, round(p_subclonal, 6) as p_subclonal from sub"


def two_clones(spark: SparkSession, d: str) -> DataFrame:
    return _clones(spark, d).select("mut_key", "is_inconsistent", "a", "b", "icn", "a1", "b1", "a2", "b2", F.round("tau1", DIGITS).alias("tau1"), F.round("tau2", DIGITS).alias("tau2"))


_P = _D(PURITY)
#: The four corners of the unit square of whole states around the raw point, and the mixtures along its triangle's sides.
_MIXTURES = f""", inv as (select mut_key, theta as y, cast(0 as double) as lo, cast(1 as double) as hi, 0 as n from sub where p_subclonal < 0.001
  union all select mut_key, y, case when {_TC("((lo + hi) / 2)")} < y then (lo + hi) / 2 else lo end, case when {_TC("((lo + hi) / 2)")} < y then hi else (lo + hi) / 2 end, n + 1 from inv where n < 40),
 raw as (select s.*, case when y <= {_TC("cast(0 as double)")} then 0 else (lo + hi) / 2 end as t, greatest({_RAW}, 0) as rc from sub s join inv i on i.mut_key = s.mut_key and n = 40),
 pt as (select *, (t * (2 + {_P} * (rc - 2)) + {_P} * rc) / (2 * {_P}) as ra from raw),
 sq as (select *, rc - ra as rb, cast(floor(ra) as bigint) as fa, cast(floor(rc - ra) as bigint) as fb from pt),
 cand as (select * from (select *, 0 as o, fa + 1 as ca, fb as cb from sq where fa + fb = cast(floor(rc) as bigint) and a = fa and b = fb
  union all select *, 0, fa, fb from sq where fa + fb = cast(floor(rc) as bigint) and a = fa + 1 and b = fb
  union all select *, 1, fa, fb + 1 from sq where fa + fb = cast(floor(rc) as bigint) and a = fa and b = fb
  union all select *, 1, fa, fb from sq where fa + fb = cast(floor(rc) as bigint) and a = fa and b = fb + 1
  union all select *, 0, fa + 1, fb + 1 from sq where fa + fb <> cast(floor(rc) as bigint) and a = fa + 1 and b = fb
  union all select *, 0, fa + 1, fb from sq where fa + fb <> cast(floor(rc) as bigint) and a = fa + 1 and b = fb + 1
  union all select *, 1, fa + 1, fb + 1 from sq where fa + fb <> cast(floor(rc) as bigint) and a = fa and b = fb + 1
  union all select *, 1, fa, fb + 1 from sq where fa + fb <> cast(floor(rc) as bigint) and a = fa + 1 and b = fb + 1) where ca >= cb and rb >= 0),
 tau as (select *, (ca - cb - t * (ca + cb) - 2 * t * (1 - {_P}) / {_P}) / (t * (a + b - ca - cb) - (a - b) + (ca - cb)) as tau from cand),
 win as (select *, b <> 0 and (cb = 0 or ca + cb > a + b) as swap, row_number() over (partition by mut_key order by tau desc, o) as k from tau where tau > 0 and tau < 1),
 cl as (select s.* exclude (a, b, icn), w.mut_key is null and s.p_subclonal < 0.001 as is_inconsistent, s.p_subclonal < 0.001 as is_subclonal, case when swap then ca else w.a end as a1, case when swap then cb else w.b end as b1,
  case when swap then 1 - tau else tau end as tau1, case when swap then w.a else ca end as a2, case when swap then w.b else cb end as b2, case when swap then tau else 1 - tau end as tau2,
  case when swap then ca else s.a end as a, case when swap then cb else s.b end as b from sub s left join win w on w.mut_key = s.mut_key and k = 1)"""
TWO_CLONES = _CASE_TESTED + _MIXTURES + " select mut_key, is_inconsistent, a, b, a + b as icn, a1, b1, a2, b2, round(tau1, 6) as tau1, round(tau2, 6) as tau2 from cl"


def _expected(spark: SparkSession, d: str) -> DataFrame:
    rows = M.expected_af(_clones(spark, d).drop("icn").withColumn("af_obs", F.col("af"))).where("af_exp is not null")
    ccf, p = M.cell_fraction(F.col("af_obs"), F.col("af_exp"), F.col("dp"))
    return rows.withColumn("ccf", ccf).withColumn("p_below", p)


def expected_af(spark: SparkSession, d: str) -> DataFrame:
    return _expected(spark, d).select("mut_key", *[F.round(c, DIGITS).alias(c) for c in ("af_exp", "copies", "copies_raw", "icn", "ccf", "p_below")])


_COPIES = f""", ic as (select *, case when is_subclonal and not is_inconsistent then (a1 + b1) * tau1 + (a2 + b2) * tau2 else cast(a + b as double) end as icn, case when a1 + b1 > a2 + b2 then tau1 else tau2 end as share from cl where a + b > 0),
 mr as (select *, af * (2 * (1 - {_P}) + {_P} * icn) / {_P} as copies_raw from ic),
 mm as (select mut_key, copies_raw, share, unnest(range(1, least(a1, a2) + 1)) as mm from mr where is_subclonal and not is_inconsistent),
 choice as (select mut_key, copies_raw, mm + h * share as m, 2 * mm + h as o from mm cross join (values (0), (1)) v(h)),
 near as (select mut_key, m, row_number() over (partition by mut_key order by abs(m - copies_raw), o) as k from choice),
 ex as (select r.*, case when is_subclonal and not is_inconsistent then coalesce(m, 1) else least(greatest(floor(copies_raw + cast(0.5 as double)), 1), a) end as copies from mr r left join near n on n.mut_key = r.mut_key and n.k = 1),
 ea as (select *, copies * {_P} / (2 * (1 - {_P}) + {_P} * icn) as af_exp from ex),
 ec as (select *, af / af_exp as ccf, sqrt(af / af_exp * (1 - af) / (dp * af_exp)) as s from ea),
 ep as (select *, case when s = 0 then 1 else (1 + {C.erf_sql("((ccf - 1) / (sqrt(cast(2 as double)) * s))")}) / 2 end as p_below from ec)"""
EXPECTED_AF = _CASE_TESTED + _MIXTURES + _COPIES + " select mut_key, round(af_exp, 6) as af_exp, round(copies, 6) as copies, round(copies_raw, 6) as copies_raw, round(icn, 6) as icn, round(ccf, 6) as ccf, round(p_below, 6) as p_below from ep"


def summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.ploidy_summary(_clones(spark, d), sample="s1"), "ploidy", "fraction_subclonal_cn", "fraction_inconsistent_segs")


_LONG = "cast(s_end - s_start as double)"
SUMMARY = (
    _CASE_TESTED
    + _MIXTURES
    + f""", w as (select *, {_LONG} as len, cast(trunc({_RAW} + cast(0.5 as double)) as bigint) as whole, n_snps >= 5 and theta_exp >= 0 and not is_inconsistent as sized from cl where tid < 22)
 select 's1' as sample_name, {_P} as purity, round(sum(len * whole) filter (whole >= 0) / sum(len) filter (whole >= 0), 6) as ploidy, round(coalesce(sum(len) filter (sized and is_subclonal), 0) / sum(len) filter (sized), 6) as fraction_subclonal_cn,
  'm' as sex_estimated, 'optimum' as status, round(coalesce(sum(len) filter (whole >= 0 and is_inconsistent), 0) / sum(len) filter (whole >= 0), 6) as fraction_inconsistent_segs from w"""
)

PURITIES, PLOIDIES, PROFILE_PLOIDIES = M.grid(0.2, 1.0, 0.01), M.grid(1.5, 4.5, 0.01), M.grid(1.0, 5.0, 0.05)


def _grid(spark: SparkSession, d: str, ploidies: list[float] = PLOIDIES) -> DataFrame:
    rows = _segments(spark, d).select("tid", "seg_id", "length", "cn", "theta", "theta_sigma", "n_snps")
    return M.fit_grid(M.eligible_segments(rows, least_snps=LEAST_SNPS), PURITIES, ploidies, SIGMA)


#: Least sites of a segment of the fit; the small tables have few.
LEAST_SNPS = 5


def fit_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select(*[F.round(c, n).alias(c) for c, n in (("purity", 6), ("ploidy", 6), ("l_bi", 2), ("l_cn", 2), ("mean_copies", 6))])


def _grid_sql(ploidies: list[float]) -> str:
    theta = C.theta_corr_sql("case when icn = 0 then cast(0 as double) else purity * (icn - 2 * b) / (2 + purity * (icn - 2)) end", _D(SIGMA))
    return (
        with_views("snps", "segments")
        + _SEGMENTS
        + f""", pu as (select unnest({PURITIES!r}::double[]) as purity), pl as (select unnest({ploidies!r}::double[]) as ploidy),
 tt as (select purity, icn, b, {theta} as te from (select purity, icn, unnest(range(icn // 2 + 1)) as b from pu cross join (select unnest(range(51)) as icn))),
 r0 as (select purity, ploidy, ploidy / (2 * purity) as scale, g.* exclude (icn) from pu cross join pl cross join g where n_snps >= {LEAST_SNPS} and tid < 22 and cn <= 5),
 r1 as (select *, (cn - 2 * (1 - purity)) * scale as raw from r0),
 r2 as (select *, cast(trunc(raw + cast(0.5 as double)) as bigint) as whole, {_WHOLE("raw")} as icn from r1),
 r3 as (select r2.*, (select min(abs(r2.theta - tt.te)) from tt where tt.purity = r2.purity and tt.icn = r2.icn) as error from r2),
 grid as (select purity, ploidy, scale, sum(case when icn = 0 or n_snps >= 5 then error * error / (2 * theta_sigma * theta_sigma) else 0 end) as l_bi, sum(case when icn = 0 or n_snps >= 5 then (raw - icn) * (raw - icn) / (2 * theta_sigma * theta_sigma) else 0 end) as l_cn,
  sum(length * greatest(whole, 1)) / sum(length) as mean_copies, sum(length * whole) filter (whole >= 0) / sum(length) filter (whole >= 0) as autosome_copies from r3 group by purity, ploidy, scale),
 per as (select *, row_number() over (partition by ploidy order by round(l_bi, 6), purity) as k from grid)"""
    )


FIT_GRID = _grid_sql(PLOIDIES) + " select round(purity, 6) as purity, round(ploidy, 6) as ploidy, round(l_bi, 2) as l_bi, round(l_cn, 2) as l_cn, round(mean_copies, 6) as mean_copies from grid"


def best_fit(spark: SparkSession, d: str) -> DataFrame:
    return M.best_fit(_grid(spark, d)).select(F.round("purity", DIGITS).alias("purity"), F.round("ploidy", DIGITS).alias("ploidy"))


BEST_FIT = _grid_sql(PLOIDIES) + " select round(purity, 6) as purity, round(ploidy, 6) as ploidy from per where k = 1 order by round(l_cn, 6), ploidy limit 1"


def profile(spark: SparkSession, d: str) -> DataFrame:
    out = M.ploidy_profile(_grid(spark, d, PROFILE_PLOIDIES))
    return out.select(*[F.round(c, n).alias(c) for c, n in (("ploidy_exp", 6), ("purity", 6), ("ploidy", 6), ("scale", 6), ("l_bi", 2), ("l_cn", 2))])


PROFILE = _grid_sql(PROFILE_PLOIDIES) + " select round(ploidy, 6) as ploidy_exp, round(purity, 6) as purity, round(autosome_copies, 6) as ploidy, round(scale, 6) as scale, round(l_bi, 2) as l_bi, round(l_cn, 2) as l_cn from per where k = 1"


def allelic_states(spark: SparkSession, d: str) -> DataFrame:
    rows = profile_.states_table(_clones(spark, d), "s1")
    return _rounded(rows, "Copy_Nr_Raw", "Theta", "Theta_Exp", "Subclonal_P_value")


_NAME = "case when tid < 22 then 'chr' || (tid + 1) when tid = 22 then 'chrX' else 'chrY' end"
ALLELIC_STATES = (
    _CASE_TESTED
    + _MIXTURES
    + f""" select 's1' as "Sample", {_NAME} as "Chromosome", s_start as "Start", s_end as "End", round({_RAW}, 6) as "Copy_Nr_Raw", a + b as "CopyNr", a as "A", b as "B", cast(b = 0 as int) as "LOH", round(theta, 6) as "Theta", round(theta_exp, 6) as "Theta_Exp",
 n_snps as "n_SNPs", cast(is_subclonal as int) as "Is_Subclonal_CN", round(p_subclonal, 6) as "Subclonal_P_value", cast(is_inconsistent as int) as "Is_Inconsistent_State" from cl where n_snps >= 1 and theta_exp >= 0 and tid <> 22"""
)


def subclonal_cn(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(profile_.subclonal_table(_clones(spark, d), "s1"), "Subclonal_CN", "Clone1_Fraction", "Clone2_Fraction")


SUBCLONAL_CN = (
    _CASE_TESTED
    + _MIXTURES
    + f""" select 's1' as "Sample", {_NAME} as "Chromosome", s_start as "Start", s_end as "End", round((a1 + b1) * tau1 + (a2 + b2) * tau2, 6) as "Subclonal_CN", a1 as "Clone1_A", b1 as "Clone1_B", round(tau1, 6) as "Clone1_Fraction",
 a2 as "Clone2_A", b2 as "Clone2_B", round(tau2, 6) as "Clone2_Fraction" from cl where is_subclonal and not is_inconsistent and tid < 22"""
)


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return _clones(spark, d).drop("icn").withColumns({"af_obs": F.col("af"), "coverage": F.col("dp"), "pos": F.col("s_start")})


def expected_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(profile_.expected_table(_seen(spark, d), "s1", alleles=True), "AF_exp", "Mut_Copies", "Mut_Copies_Raw", "iCN", "P_Is_Clonal", "tau1", "tau2")


_KIND = "case when length(ref) = 1 and length(alt) = 1 then '_SNM' when length(alt) = 1 then '_DEL' when length(ref) = 1 then '_INS' end"
_OWN = lambda c: f"case when is_subclonal and not is_inconsistent then {c} else -1 end"
EXPECTED_FREQUENCIES = (
    _CASE_TESTED
    + _MIXTURES
    + _COPIES
    + f""" select 's1_' || {_NAME} || ':' || s_start || {_KIND} as "Mut_ID", {_NAME} as "Chr", s_start as "Position", ref as "Wt", alt as "Mut", af as "AF_obs", dp as "Coverage", round(af_exp, 6) as "AF_exp", round(copies, 6) as "Mut_Copies", round(copies_raw, 6) as "Mut_Copies_Raw",
 cast(is_subclonal as int) as "Is_Subclonal_CN", round(icn, 6) as "iCN", round(p_below, 6) as "P_Is_Clonal", case when is_subclonal and not is_inconsistent then -1 else a end as "CN_A", case when is_subclonal and not is_inconsistent then -1 else b end as "CN_B",
 round({_OWN("tau1")}, 6) as tau1, {_OWN("a1")} as "CN_Clone1_A", {_OWN("b1")} as "CN_Clone1_B", round({_OWN("tau2")}, 6) as tau2, {_OWN("a2")} as "CN_Clone2_A", {_OWN("b2")} as "CN_Clone2_B" from ep where {_KIND} is not null"""
)


def phylogeny(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(profile_.phylogeny_table(_seen(spark, d), "s1"), "mu_v")


PHYLOGENY = (
    _CASE_TESTED
    + _MIXTURES
    + _COPIES
    + f""" select 's' || (row_number() over (order by tid, s_start, ref, alt) - 1) as id, 's1_' || {_NAME} || ':' || s_start || '_SNM' as gene, cast(trunc(dp * (1 - af) + cast(0.1 as double)) as bigint) as a, dp as d, cast(0.999 as double) as mu_r, round(1 - af_exp, 6) as mu_v
 from ep where length(ref) = 1 and length(alt) = 1"""
)


def _profile_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from cytoframe.plans.interval_queries import _counts

    parts = _counts(spark, d).withColumn("gc", F.col("gc_permille") / 1000.0)
    sites = snps(spark, d).withColumn("part_no", (F.col("tid") * 1000 + F.floor((F.col("pos") - 1) / 1000)).cast("bigint"))
    return parts, sites


def profile_of_parts(spark: SparkSession, d: str) -> DataFrame:
    parts, _ = _profile_inputs(spark, d)
    breaks = mutations(spark, d).where("alt = 'CG'").select("tid", "pos")
    out = profile_.copy_number_profile(parts, least_length=5_000, least_reads=8, breaks=breaks)
    return out.select("part_no", "window", "segment", "cn_coarse", "cn")


def refined(spark: SparkSession, d: str) -> DataFrame:
    """Summary of the fit refined in two rounds."""
    parts, sites = _profile_inputs(spark, d)
    cut = written(profile_.copy_number_profile(parts, least_length=5_000, least_reads=8), "profile")
    muts = mutations(spark, d).select("mut_key", "tid", "pos", F.col("af").alias("af_obs"), F.col("dp").alias("coverage"))
    fit, states, _ = profile_.refined_fit(cut, sites, SIGMA, purities=PURITIES, ploidies=PLOIDIES, least_snps=LEAST_SNPS, mutations=muts)
    return M.ploidy_summary(states, mode=fit.mode, sample="s1")


def copy_number_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark).where("tid < 22").withColumn("icn", F.floor(F.col("icn") / 2))
    runs = islands(rows, group=["tid"], order=["seg"], by=["icn"])
    return runs.groupBy("tid", "run", "icn").agg(F.min("s_start").alias("s_start"), F.max("s_end").alias("s_end"), F.count("*").alias("n")).drop("run")


COPY_NUMBER_RUNS = (
    with_views("segments")
    + ", x as (select *, icn // 2 as c from segments where tid < 22), y as (select *, case when lag(c) over w = c or lag(c) over w is null then 0 else 1 end as f from x window w as (partition by tid order by seg)), z as (select *, sum(f) over (partition by tid order by seg) as run from y) select tid, c as icn, min(s_start) as s_start, max(s_end) as s_end, count(*) as n from z group by tid, run, c"
)


#: Least points of a side, significance, and a point that ends a part, in the segments below.
SIDE, ALPHA, FORCED = 20, 1e-3, 499


def _grouped_segments(spark: SparkSession, d: str, kernel) -> DataFrame:
    from cytoframe.plans.interval_queries import _counts

    rows = _counts(spark, d).select("tid", "part_no", "p_start", "p_end", F.log1p(F.col("n_t").cast("double")).alias("x"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part_no", ignore_index=True)
        x = frame.x.to_numpy()
        variance = max(float(np.var(x)), 1e-9) / len(x) * (1 + np.arange(len(x)) % 5)
        found = kernel(x, variance, ALPHA, SIDE, (FORCED,))
        return pd.DataFrame([(frame.tid[0], int(frame.p_start[a]), int(frame.p_end[b]), b - a + 1, round(float(x[a : b + 1].mean()), 9)) for a, b in found], columns=["tid", "s_start", "s_end", "n", "mean_x"])

    return rows.groupBy("tid").applyInPandas(run, "tid int, s_start bigint, s_end bigint, n bigint, mean_x double")


def _segments_sql(scores: str) -> str:
    """Parts as rows of a recursion; scores: select list of c (last point of a left part) and score over a part's prefix sums ts (values) and vs (variances)."""
    from math import erfc, sqrt

    from cytoframe.plans.interval_queries import _COUNTS

    low, high = 0.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if erfc(middle / sqrt(2)) <= ALPHA else (middle, high)
    return (
        with_views("reads", "partitions").replace("with ", "with recursive ", 1)
        + _COUNTS
        + f""", pts as (select tid, bin as i, ln(cast(1 + n_t as double)) as x from counts), var as (select tid, greatest(var_pop(x), 1e-9) / 1000 as s2 from pts group by tid),
 pre as (select tid, i, sum(x) over w as t, sum(s2 * (1 + i % 5)) over w as v from pts join var using (tid) window w as (partition by tid order by i)),
 sums as (select tid, [cast(0 as double)] || list(t order by i) as ts, [cast(0 as double)] || list(v order by i) as vs from pre group by tid),
 parts as (select tid, unnest([0, {FORCED + 1}]) as a, unnest([{FORCED}, 999]) as b from sums
  union all select tid, unnest([a, s + 1]), unnest([s, b]) from (
   select tid, a, b, max(best) as best, min(c) filter (score >= best * (1 - 1e-9)) as s from (
    select *, max(score) over (partition by tid, a, b) as best from (select tid, a, b, {scores})) group by tid, a, b) where best >= {low!r}),
 leaf as (select tid, a, min(b) as b from parts group by tid, a),
 opened as (select tid, a, b from leaf where a <> {FORCED + 1} union all select tid, a, a from leaf where a = {FORCED + 1} union all select tid, a + 1, b from leaf where a = {FORCED + 1} and b > a)
 select tid, cast(a * 1000 + 1 as bigint) as s_start, cast(b * 1000 + 1000 as bigint) as s_end, cast(b - a + 1 as bigint) as n, round((ts[b + 2] - ts[a + 1]) / (b - a + 1), 9) as mean_x from opened join sums using (tid)"""
    )


def binary_segments(spark: SparkSession, d: str) -> DataFrame:
    return _grouped_segments(spark, d, kernels.binary_segments)


_SIDES = lambda t: (f"({t}[a + {SIDE}] - {t}[a + 1] + {t}[c + 2] - {t}[a + {SIDE + 1}])", f"({t}[a + {SIDE + 1}] - {t}[a + {SIDE}] + {t}[b + 2] - {t}[c + 2])")
BINARY_SEGMENTS = _segments_sql(
    f"c, abs({_SIDES('ts')[0]} / (c - a) - {_SIDES('ts')[1]} / (b - c + 1)) / sqrt({_SIDES('vs')[0]} / (c - a) + {_SIDES('vs')[1]} / (b - c + 1)) as score"
    f" from (select tid, a, b, ts, vs, unnest(range(a + {SIDE}, b - {SIDE} + 2)) as c from parts join sums using (tid))"
)


def flank_segments(spark: SparkSession, d: str) -> DataFrame:
    return _grouped_segments(spark, d, kernels.flank_segments)


_FLANKS = lambda t: (f"({t}[c + 1] - {t}[c - {SIDE - 1}])", f"({t}[c + {SIDE + 2}] - {t}[c + 2])")
FLANK_SEGMENTS = _segments_sql(
    f"c, abs({_FLANKS('ts')[0]} - {_FLANKS('ts')[1]}) / {SIDE} / sqrt(({_FLANKS('vs')[0]} + {_FLANKS('vs')[1]}) / {SIDE**2}) as score"
    f" from (select tid, a, b, ts, vs, unnest(range(a + {SIDE + 1}, b - {SIDE} + 1)) as c from parts join sums using (tid))"
)


def gc_curve(spark: SparkSession, d: str) -> DataFrame:
    """Median depth by GC content and its smooth curve, relative to the overall median."""
    from cytoframe.plans.interval_queries import _counts

    bins = M.gc_bins(_counts(spark, d).withColumn("gc", F.col("gc_permille") / 1000.0), "n_n", bins=200)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("gc_bin", ignore_index=True)
        fit, _, _ = kernels.smoothing_spline(frame.gc_bin.to_numpy(float), frame.median_value.to_numpy(float), frame.weight.to_numpy(float))
        return frame.assign(curve=fit)[["gc_bin", "median_value", "curve"]]

    # at most as many rows as there are bins
    return bins.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "gc_bin int, median_value double, curve double")


def site_runs(spark: SparkSession, d: str) -> DataFrame:
    """Segments of sites over partitions whose copies change every 50,000 positions, and within some chromosomes every 10,000."""
    sites = snps(spark, d).withColumn("part_no", (F.col("tid") * 1000 + F.floor((F.col("pos") - 1) / 1000)).cast("bigint"))
    parts = partitions(spark).withColumn("cn", F.expr(_COPIES_OF_PARTS))
    return profile_.site_segments(sites, parts, "cn").select("seg_id", "tid", "s_start", "s_end", "cn", "n_snps")


_COPIES_OF_PARTS = "cast(case when tid % 3 = 0 then bin div 10 else bin div 50 end % 4 as double)"
SITE_RUNS = (
    with_views("snps", "partitions").replace("with ", "with recursive ", 1)
    + f""", s0 as (select s.*, p_start, p_end, {_COPIES_OF_PARTS.replace(" div ", " // ").replace("tid", "p.tid")} as cn, t_a + t_b >= 15 and n_a + n_b >= 15 and pow(0.5 - abs(t_a / cast(t_a + t_b as double) - 0.5), 2) + pow(0.5 - abs(n_a / cast(n_a + n_b as double) - 0.5), 2) >= 0.15 * 0.15 as ok
  from snps s join partitions p on s.tid = p.tid and p.bin = (s.pos - 1) // 1000),
 s1 as (select *, row_number() over (order by tid, pos, t_a, t_b, n_a, n_b) as k from s0), n as (select max(k) as n from s1),
 fold as (select 1 as k, 0 as seg, 0 as seen, tid as name, p_start as first, p_end as reach, cn as level, false as out, 0 as o_tid, cast(0 as bigint) as o_first, cast(0 as bigint) as o_reach, cast(0 as double) as o_cn, 0 as o_n, case when ok then 1 else 0 end as seen_now from s1 where k = 1
  union all select s.k, seg + case when hit then 1 else 0 end, 0, case when hit then s.tid else name end, case when hit then s.p_start else first end,
    case when not hit and s.p_end >= first then s.p_end else reach end, s.cn, hit, name, first, reach, level, seen_now, case when hit then 0 else seen_now end + case when s.ok then 1 else 0 end
   from (select f.*, (s.cn <> f.level or s.tid <> f.name or s.k = n) and f.seen_now >= 20 as hit, s as s from fold f join s1 s on s.k = f.k + 1 cross join n))
 select cast(seg - 1 as bigint) as seg_id, o_tid as tid, o_first as s_start, o_reach as s_end, o_cn as cn, cast(o_n as bigint) as n_snps from fold where out"""
)

QUERIES = {
    "x3_special_functions": (special_functions, SPECIAL_FUNCTIONS),
    "f12_informative_sites": (informative_sites, INFORMATIVE_SITES),
    "a12_imbalance": (imbalance, IMBALANCE),
    "a13_folded_sigma": (folded_sigma, FOLDED_SIGMA),
    "m5_allele_states": (allele_states, ALLELE_STATES),
    "m6_fit_grid": (fit_grid, FIT_GRID),
    "m6_best_fit": (best_fit, BEST_FIT),
    "m7_profile": (profile, PROFILE),
    "m10_subclonal": (subclonal, SUBCLONAL),
    "m11_two_clones": (two_clones, TWO_CLONES),
    "m13_expected_af": (expected_af, EXPECTED_AF),
    "m15_summary": (summary, SUMMARY),
    "m1_profile": (profile_of_parts, None),
    "m9_refined_fit": (refined, None),
    "sk4_allelic_states": (allelic_states, ALLELIC_STATES),
    "sk5_subclonal_cn": (subclonal_cn, SUBCLONAL_CN),
    "sk7_expected_af": (expected_frequencies, EXPECTED_FREQUENCIES),
    "sk8_phylogeny_input": (phylogeny, PHYLOGENY),
    "m12_copy_number_runs": (copy_number_runs, COPY_NUMBER_RUNS),
    "w2_binary_segments": (binary_segments, BINARY_SEGMENTS),
    "w3_flank_segments": (flank_segments, FLANK_SEGMENTS),
    "w6_site_runs": (site_runs, SITE_RUNS),
    "n1_gc_curve": (gc_curve, None),
}
