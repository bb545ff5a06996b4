"""Read depth, allelic imbalance and the copy-number model, as DataFrame expressions.

Rows of partitions, sites and mutations stay distributed; what is fitted is a function of segments, of which there
are few. The grid of purities and ploidies is a table that segments are joined to, and each grid point is one group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoframe.functions.columns import erf, sex_factor, theta_corr, theta_inverse, truncate_half
from cytoframe.operators.intervals import range_join
from cytoframe.session import written

#: Fixed values of the model.
LEAST_THETA_SIGMA = 0.015
MAX_COPIES = 50
CAPPED_COPIES = 49
SUBCLONAL_P = 0.001
FOLD_PI = 3.141593


def partition_counts(reads: DataFrame, partitions: DataFrame, *, width: int = 10_000, ref: str | None = None) -> DataFrame:
    """tid, part_no, n_t, n_n: placed reads (mapq > 0) that begin in each partition, 0 where there are none.

    ref: column of the reference's base where a read begins; reads that begin at an unknown base (N) don't count.
    Reads are counted by (tid, bin of positions, sample) first where a partition is narrower, a join by bins follows.
    """
    known = F.lit(True) if ref is None else F.upper(ref) != "N"
    placed = reads.where((F.col("mapq") > 0) & known).groupBy("tid", "pos").agg(F.count_if(F.col("sample") == "T").alias("t"), F.count_if(F.col("sample") == "N").alias("n"))
    hit = range_join(placed, partitions.select("tid", "part_no", "p_start", "p_end"), group="tid", at="pos", begin="p_start", end="p_end", width=width)
    counts = hit.groupBy("part_no").agg(F.sum("t").alias("n_t"), F.sum("n").alias("n_n"))
    return partitions.select("tid", "part_no").join(counts, "part_no", "left").select("tid", "part_no", F.coalesce("n_t", F.lit(0)).alias("n_t"), F.coalesce("n_n", F.lit(0)).alias("n_n"))


def gc_fraction(bases: DataFrame, by: list[str], *, base: str = "base", n: str = "n") -> DataFrame:
    """by, share of G and C among known bases; -1 where all are unknown. n: how often a row counts."""
    known = F.sum(F.when(F.col(base).isin("A", "C", "G", "T"), F.col(n)).otherwise(0))
    gc = F.sum(F.when(F.col(base).isin("G", "C"), F.col(n)).otherwise(0))
    return bases.groupBy(*by).agg(F.coalesce(F.try_divide(gc, known), F.lit(-1.0)).alias("gc"))


def genome_totals(parts: DataFrame) -> DataFrame:
    """One row: genome size, reads of both samples, their ratio, and the sex by normal depth on Y against X."""
    size = (F.col("p_end") - F.col("p_start") + 1).cast("double")
    depth = lambda t: F.avg(F.when(F.col("tid") == t, F.col("n_t") / size))
    ratio = F.try_divide(depth(23), depth(22))
    return parts.agg(
        F.sum(F.col("p_end") - F.col("p_start") + 1).alias("genome_size"),
        F.sum("n_t").alias("reads_t"),
        F.sum("n_n").alias("reads_n"),
        F.try_divide(F.sum("n_n").cast("double"), F.sum("n_t").cast("double")).alias("ratio_n_t"),
        F.when(F.coalesce(ratio < 0.2, F.lit(False)), "f").otherwise("m").alias("sex"),
    )


def gc_bins(parts: DataFrame, value: str, *, gc: str = "gc", bins: int = 1000) -> DataFrame:
    """gc_bin, median of value and weight (root of rows) of equal-width bins of GC content; unknown GC is left out."""
    rows = parts.where(F.col(gc) >= 0).withColumn("gc_bin", F.floor(F.col(gc) * bins).cast("int"))
    return rows.groupBy("gc_bin").agg(F.median(value).alias("median_value"), F.sqrt(F.count("*")).alias("weight"))


def gc_variance(parts: DataFrame, residual: str, *, gc: str = "gc", bins: int = 100, least: int = 5) -> DataFrame:
    """gc_bin, mean squared residual; bins of at most ``least`` rows take the largest variance of the others (0 without any)."""
    rows = parts.where(F.col(gc) >= 0).withColumn("gc_bin", F.floor(F.col(gc) * bins).cast("int"))
    each = rows.groupBy("gc_bin").agg(F.avg(F.col(residual) * F.col(residual)).alias("v"), F.count("*").alias("n"))
    full = F.when(F.col("n") > least, F.col("v"))
    # at most bins + 1 rows
    return each.select("gc_bin", "n", F.coalesce(full, F.max(full).over(W.partitionBy(F.lit(1))), F.lit(0.0)).alias("variance"))


def segment_ratios(parts: DataFrame, *, segment: str, ratio: str, chromosome: str = "tid", sex: str = "m") -> DataFrame:
    """parts with the segment's mean ratio as copies (twice the mean and the sex factor), and log residual."""
    mean = F.avg(ratio).over(W.partitionBy(segment))
    return parts.withColumn("copies", mean * 2 * sex_factor(F.col(chromosome), F.lit(sex))).withColumn("residual", F.when((F.col(ratio) > 0) & (mean > 0), F.ln(F.col(ratio) / mean)))


def heterozygous_sites(sites: DataFrame, *, least_depth: int = 15) -> DataFrame:
    """Sites deep enough in both samples and far enough from being homozygous. sites: t_a, t_b, n_a, n_b."""
    return sites.where(is_heterozygous(least_depth))


def is_heterozygous(least_depth: int = 15) -> Column:
    """Whether a site (t_a, t_b, n_a, n_b) is one of ``heterozygous_sites``."""
    t, n = F.col("t_a") + F.col("t_b"), F.col("n_a") + F.col("n_b")
    inner = lambda a, d: 0.5 - F.abs(F.try_divide(a.cast("double"), d.cast("double")) - 0.5)
    x, y = inner(F.col("t_a"), t), inner(F.col("n_a"), n)
    return (t >= least_depth) & (n >= least_depth) & F.coalesce(x * x + y * y >= 0.15 * 0.15, F.lit(False))


def imbalance(a: Column, b: Column) -> Column:
    """4 (share of a - 1/2) squared."""
    p = F.try_divide(a.cast("double"), (a + b).cast("double")) - 0.5
    return 4 * p * p


def imbalance_by(sites: DataFrame, by: list[str], *, a: str = "t_a", b: str = "t_b") -> DataFrame:
    """by, n_snps, theta (root of the median imbalance) and theta_sigma (at least LEAST_THETA_SIGMA)."""
    rows = sites.withColumn("_xi", imbalance(F.col(a), F.col(b)))
    theta = rows.groupBy(*by).agg(F.sqrt(F.median("_xi")).alias("theta"), F.count("*").alias("n_snps"))
    d = F.sqrt("_xi") - F.col("theta")
    spread = rows.join(theta, by).groupBy(*by, "theta", "n_snps").agg(F.sqrt(F.sum(d * d)).alias("_s"))
    return spread.select(*by, "n_snps", "theta", F.greatest(F.col("_s") / F.col("n_snps"), F.lit(LEAST_THETA_SIGMA)).alias("theta_sigma"))


def normal_heterozygous_sites(sites: DataFrame, *, least_depth: int = 15) -> DataFrame:
    """Sites deep enough in both samples and far enough from being homozygous in the normal one."""
    n = F.col("n_a") + F.col("n_b")
    y = 0.5 - F.abs(F.try_divide(F.col("n_a").cast("double"), n.cast("double")) - 0.5)
    return sites.where((F.col("t_a") + F.col("t_b") >= least_depth) & (n >= least_depth) & (y * y >= 0.15 * 0.15))


def folded_sigma(sites: DataFrame, by: list[str], ratio: float) -> DataFrame:
    """by, noise of the imbalance in the normal sample, folded back from its median. ratio: reads of the normal over those of the tumour sample."""
    xi = imbalance(F.col("n_a"), F.col("n_b"))
    return normal_heterozygous_sites(sites).groupBy(*by).agg(F.sqrt(F.median(xi) * F.lit(float(ratio)) * FOLD_PI / 8).alias("sigma"))


def raw_copies(cn: Column, purity: Column, scale: Column) -> Column:
    """Copies in tumour cells, not yet whole."""
    return (cn - 2 * (1 - purity)) * scale


def whole_copies(cn: Column, purity: Column, scale: Column) -> Column:
    """Copies in tumour cells as a whole number: below 0 is 0, above MAX_COPIES is CAPPED_COPIES."""
    x = truncate_half(raw_copies(cn, purity, scale))
    return F.when(x > MAX_COPIES, CAPPED_COPIES).when(x < 0, 0).otherwise(x)


def expected_imbalance(purity: Column, icn: Column, b: Column, sigma: float) -> Column:
    """Imbalance of icn copies, b of them of the rarer allele, under the sample's noise; without copies that of noise alone."""
    theta = F.when(icn == 0, 0.0).otherwise(purity * (icn - 2 * b) / (2 + purity * (icn - 2)))
    return theta_corr(theta, F.lit(float(sigma)))


def allele_states(segments: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """keys, icn, a, b, theta_exp, error and weight ls of the best pair of alleles of each segment.

    segments: cn, theta, n_snps, purity, scale; sigma is the sample's folded noise. The pair with A + B = icn whose
    expected imbalance is nearest wins, of equals the smaller B. Without copies A = B = 0; otherwise a segment of under 5
    sites has -1 for a, b and theta_exp, and a null error.
    """
    own = segments.withColumn("icn", whole_copies(F.col("cn"), F.col("purity"), F.col("scale")))
    each = own.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor(F.col("icn") / 2).cast("int")))).withColumn("a", F.col("icn") - F.col("b"))
    each = each.withColumn("theta_exp", expected_imbalance(F.col("purity"), F.col("icn"), F.col("b"), sigma))
    each = each.withColumn("error", F.abs(F.col("theta") - F.col("theta_exp")))
    # distance between neighbouring pairs, by which a segment tells them apart
    after = expected_imbalance(F.col("purity"), F.col("icn"), F.col("b") + 1, sigma)
    single = F.abs(F.col("theta_exp") - expected_imbalance(F.col("purity"), F.lit(0), F.lit(0), sigma))
    step = F.when(F.col("icn") == 1, single).when(F.col("b") < F.floor(F.col("icn") / 2), F.abs(F.col("theta") - F.col("theta_exp") - after))
    pair = F.struct(F.round("error", 9).alias("e"), "b", "a", "theta_exp", "error", "icn", "n_snps")
    best = each.groupBy(*keys).agg(F.min(pair).alias("x"), F.min(step).alias("step")).select(*keys, "x.*", "step")
    empty = F.col("icn") == 0
    known = empty | (F.col("n_snps") >= 5)
    ls = F.when(known & ~empty, F.try_divide(F.lit(1.0), F.when(F.col("icn") == 1, F.col("step")).otherwise(F.least("step", F.lit(1.0)))))
    return best.select(*keys, "icn", *[F.when(known, F.col(c)).otherwise(-1).alias(c) for c in ("a", "b", "theta_exp")], F.when(known, F.col("error")).alias("error"), ls.alias("ls"))


def grid(first: float, last: float, step: float) -> list[float]:
    """first, first + step and so on by repeated addition while not above last; the sums' own rounding decides the end."""
    out, x = [], first
    while x <= last:
        out.append(x)
        x += step
    return out


def _expected_pairs(segments: DataFrame, purities: list[float], sigma: float) -> DataFrame:
    """purity, icn, thetas (by rising B): expected imbalances of every whole number of copies, a few thousand rows of the grid."""
    points = segments.sparkSession.createDataFrame([(float(p),) for p in purities], "purity double")
    each = points.select("purity", F.explode(F.sequence(F.lit(0), F.lit(MAX_COPIES))).alias("icn")).select("purity", "icn", F.explode(F.sequence(F.lit(0), F.floor(F.col("icn") / 2).cast("int"))).alias("b"))
    each = each.withColumn("theta_exp", expected_imbalance(F.col("purity"), F.col("icn"), F.col("b"), sigma))
    pairs = F.array_sort(F.collect_list(F.struct("b", "theta_exp")))
    return each.groupBy("purity", F.col("icn").cast("bigint").alias("icn")).agg(F.transform(pairs, lambda x: x["theta_exp"]).alias("thetas"))


def fit_grid(segments: DataFrame, purities: list[float], ploidies: list[float], sigma: float) -> DataFrame:
    """purity, ploidy, scale, l_bi (misfit of imbalance), l_cn (misfit of depth), mean_copies and autosome_copies for every grid point.

    segments: tid, seg_id, length, cn, theta, theta_sigma, n_snps; sigma is the sample's folded noise. Segments with copies but under 5
    sites have no misfit. mean_copies counts a segment without copies as 1; autosome_copies leaves out sex chromosomes and negative copies.
    Every segment is set out by purity, then ploidy, and summed to the grid before the shuffle; what imbalances copies are
    expected to show depends on purity and copies alone and is looked up.
    """
    own = segments.select("tid", "seg_id", "length", "cn", "theta", "theta_sigma", "n_snps", F.explode(F.array(*[F.lit(float(p)) for p in purities])).alias("purity"))
    dealt = own.repartition(segments.sparkSession.sparkContext.defaultParallelism, "seg_id", "purity")
    rows = dealt.withColumn("ploidy", F.explode(F.array(*[F.lit(float(q)) for q in ploidies]))).withColumn("scale", F.col("ploidy") / (2 * F.col("purity")))
    raw = raw_copies(F.col("cn"), F.col("purity"), F.col("scale"))
    rows = rows.withColumn("raw", raw).withColumn("whole", truncate_half(raw)).withColumn("icn", whole_copies(F.col("cn"), F.col("purity"), F.col("scale")).cast("bigint"))
    # as many rows as the grid has purities and copies
    rows = rows.join(F.broadcast(_expected_pairs(segments, purities, sigma)), ["purity", "icn"])
    error = F.array_min(F.transform("thetas", lambda t: F.abs(F.col("theta") - t)))
    fits = (F.col("icn") == 0) | (F.col("n_snps") >= 5)
    variance = 2 * F.col("theta_sigma") * F.col("theta_sigma")
    squared = lambda x: F.sum(F.when(fits, x * x / variance).otherwise(0.0))
    some = (F.col("tid") < 22) & (F.col("whole") >= 0)
    return rows.withColumn("error", error).groupBy("purity", "ploidy", "scale").agg(
        squared(F.col("error")).alias("l_bi"),
        squared(F.col("raw") - F.col("icn")).alias("l_cn"),
        F.try_divide(F.sum(F.col("length") * F.greatest("whole", F.lit(1))), F.sum("length")).alias("mean_copies"),
        F.try_divide(F.sum(F.when(some, F.col("length") * F.col("whole"))), F.sum(F.when(some, F.col("length")))).alias("autosome_copies"),
    )


def best_fit(points: DataFrame) -> DataFrame:
    """Per ploidy the purity of least l_bi, then the ploidy of least l_cn (of equals the first): one row."""
    per = points.groupBy("ploidy").agg(F.min(F.struct(F.round("l_bi", 6).alias("l"), "purity", "l_bi", "l_cn")).alias("x")).select("ploidy", "x.purity", "x.l_bi", "x.l_cn")
    best = per.agg(F.min(F.struct(F.round("l_cn", 6).alias("l"), "ploidy", "purity", "l_bi", "l_cn")).alias("x"))
    return best.select("x.purity", "x.ploidy", "x.l_bi", "x.l_cn")


def ploidy_profile(points: DataFrame) -> DataFrame:
    """ploidy_exp, purity, ploidy, scale and misfits: for each expected ploidy its best purity and the mean copies of autosomes there."""
    best = F.min(F.struct(F.round("l_bi", 6).alias("l"), "purity", "autosome_copies", "scale", "l_bi", "l_cn")).alias("x")
    return points.groupBy("ploidy").agg(best).select(F.col("ploidy").alias("ploidy_exp"), "x.purity", F.col("x.autosome_copies").alias("ploidy"), "x.scale", "x.l_bi", "x.l_cn")


def subclonal_test(segments: DataFrame) -> DataFrame:
    """segments (theta, theta_exp, theta_sigma, a, b, n_snps) with p_subclonal and is_subclonal.

    p is 1 where a segment has under 5 sites or no expected imbalance, and where the difference can't come from a second clone:
    balanced alleles that look more balanced, or one lost allele that looks more than lost.
    """
    p = 1 - erf(F.abs(F.col("theta") - F.col("theta_exp")) / (math.sqrt(2) * F.col("theta_sigma")))
    known = (F.col("n_snps") >= 5) & (F.col("theta_exp") >= 0)
    wrong = ((F.col("a") == F.col("b")) & (F.col("theta") < F.col("theta_exp"))) | ((F.col("b") == 0) & (F.col("theta") > F.col("theta_exp")))
    low = p < SUBCLONAL_P
    tested = segments.withColumn("p_subclonal", F.when(known & ~(low & wrong), p).otherwise(1.0))
    return tested.withColumn("is_subclonal", F.col("p_subclonal") < SUBCLONAL_P)


def two_clones(segments: DataFrame, sigma: float) -> DataFrame:
    """Subclonal segments (cn, theta, a, b, purity, scale) as a mixture of two whole states.

    The imbalance without noise and the raw copies give raw copies of either allele, a point in a unit square of whole
    states. The fitted state (a, b) is one corner of the triangle of that square in which the point lies; the other
    state is another corner of it that differs by one copy of one allele and has A >= B. The mixture that explains
    the imbalance gives the fitted state a share tau between 0 and 1; the largest share wins. Adds a1, b1, tau1, a2, b2,
    tau2 (null without a mixture), is_inconsistent where none fits, and has a, b and icn of the first clone.
    """
    bare = theta_inverse(F.col("theta"), F.lit(float(sigma)))
    state = F.pandas_udf(_mixtures, "a1 bigint, b1 bigint, tau1 double, a2 bigint, b2 bigint, tau2 double")
    subclonal = F.coalesce(F.col("is_subclonal"), F.lit(False))
    rows = segments.withColumn("_s", state(bare, F.col("cn"), F.col("a").cast("bigint"), F.col("b").cast("bigint"), F.col("purity"), F.col("scale"), subclonal))
    first = lambda c: F.coalesce(F.col(f"_s.{c}1"), F.col(c).cast("bigint"))
    return rows.select(*[F.col(c) for c in segments.columns if c not in ("a", "b", "icn")], "_s.*", (subclonal & F.col("_s.a1").isNull()).alias("is_inconsistent"), first("a").alias("a"), first("b").alias("b"), (first("a") + first("b")).alias("icn"))


def _mixtures(theta: pd.Series, cn: pd.Series, a: pd.Series, b: pd.Series, purity: pd.Series, scale: pd.Series, subclonal: pd.Series) -> pd.DataFrame:
    t, p, a, b = (x.to_numpy(float) for x in (theta, purity, a, b))
    with np.errstate(divide="ignore", invalid="ignore"):
        raw = np.maximum((cn.to_numpy(float) - 2 * (1 - p)) * scale.to_numpy(float), 0)
        raw_a = (t * (2 + p * (raw - 2)) + p * raw) / (2 * p)
        raw_b = raw - raw_a
        low_a, low_b = np.floor(raw_a), np.floor(raw_b)
        lower = low_a + low_b == np.floor(raw)

        def other(x: np.ndarray, low: np.ndarray, fixed: np.ndarray, fixed_low: np.ndarray) -> np.ndarray:
            # the corner across the allele that changes, if the one that doesn't is at the triangle's right angle
            across = np.where(x == low, low + 1, np.where(x == low + 1, low, np.nan))
            return np.where(fixed == fixed_low + ~lower, across, np.nan)

        def share(a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
            # of the fitted state, at which both states' allele differences and copies, with the normal cells, give theta
            tau = ((a2 - b2) - t * (a2 + b2) - 2 * t * (1 - p) / p) / (t * (a + b - a2 - b2) - (a - b) + (a2 - b2))
            return np.where((tau > 0) & (tau < 1) & (a2 >= b2), tau, -1.0)

        other_a, other_b = other(a, low_a, b, low_b), other(b, low_b, a, low_a)
        tau_a, tau_b = share(other_a, b), share(a, other_b)
    by_a = np.where(lower, tau_a >= tau_b, tau_a > tau_b)
    tau = np.where(by_a, tau_a, tau_b)
    found = (tau > 0) & (raw_b >= 0) & subclonal.to_numpy(bool)
    a2, b2 = np.where(by_a, other_a, a), np.where(by_a, b, other_b)
    # the fitted state comes second where the other lost an allele or has more copies
    swap = (b != 0) & ((b2 == 0) | (a2 + b2 > a + b))
    first, second = (np.where(swap, a2, a), np.where(swap, b2, b), np.where(swap, 1 - tau, tau)), (np.where(swap, a, a2), np.where(swap, b, b2), np.where(swap, tau, 1 - tau))
    columns = [pd.Series(np.where(found, x, np.nan)).astype(k) for x, k in zip((*first, *second), ("Int64", "Int64", "Float64") * 2)]
    return pd.DataFrame(dict(zip(("a1", "b1", "tau1", "a2", "b2", "tau2"), columns)))


def expected_af(mutations: DataFrame) -> DataFrame:
    """mutations (af_obs, purity, a, b, is_subclonal, is_inconsistent, a1, b1, tau1, a2, b2, tau2) with copies, copies_raw, icn and af_exp.

    On a clonal segment a mutation has its nearest whole number of copies, at least 1 and at most A. On one of two clones
    it has that of 1 to the smaller A, or one of these and the share of the clone of more copies, whichever is nearest; 1 if there
    is none. Null without copies.
    """
    p, total = F.col("purity"), F.col("a") + F.col("b")
    mixed = F.col("is_subclonal") & ~F.col("is_inconsistent")
    one, two = F.col("a1") + F.col("b1"), F.col("a2") + F.col("b2")
    icn = F.when(mixed, one * F.col("tau1") + two * F.col("tau2")).otherwise(total.cast("double"))
    rows = mutations.withColumn("icn", F.when(total > 0, icn)).withColumn("copies_raw", F.col("af_obs") * (2 * (1 - p) + p * F.col("icn")) / p)
    share = F.when(one > two, F.col("tau1")).otherwise(F.col("tau2"))
    most = F.least("a1", "a2")
    steps = F.flatten(F.transform(F.when(most >= 1, F.sequence(F.lit(1), most.cast("int"))), lambda m: F.array(m.cast("double"), m + share)))
    nearest = F.array_min(F.transform(steps, lambda m, k: F.struct(F.abs(m - F.col("copies_raw")).alias("d"), k.alias("k"), m.alias("m"))))["m"]
    whole = F.least(F.greatest(F.floor(F.col("copies_raw") + 0.5), F.lit(1)), F.col("a")).cast("double")
    rows = rows.withColumn("copies", F.when(mixed, F.coalesce(nearest, F.lit(1.0))).otherwise(whole))
    return rows.withColumn("af_exp", F.col("copies") * p / (2 * (1 - p) + p * F.col("icn")))


def cell_fraction(af: Column, af_exp: Column, depth: Column) -> tuple[Column, Column]:
    """Share of cells with a mutation, and the probability that it is below 1 (1 where nothing varies)."""
    ccf = F.try_divide(af, af_exp)
    sigma = F.sqrt(F.try_divide(ccf * (1 - af), depth * af_exp))
    return ccf, F.when(sigma == 0, 1.0).otherwise((1 + erf((ccf - 1) / (math.sqrt(2) * sigma))) / 2)


def refine_purity(segments: DataFrame, mutations: DataFrame, *, sigma: float, purity: float = 1.0, scale: float = 1.0, ploidy: float = 1.5, rounds: int = 5) -> tuple[float, float]:
    """Purity and ploidy from mutations, for a sample whose copies don't tell.

    In each round purity is multiplied by the fraction of the largest clonal cluster, up to 1; the scale follows from purity and
    ploidy, and the mean copies at that scale are the next ploidy. segments: seg_id, length, cn, theta, n_snps; mutations: mut_key, seg_id,
    af_obs, coverage. Only a sample's histogram and its few clusters meet in one place.
    """
    from cytoframe.operators import clustering as K

    for _ in range(rounds):
        at = {"purity": F.lit(purity), "scale": F.lit(scale)}
        states = allele_states(segments.withColumns(at), ["seg_id"], sigma).where("a >= 0").select("seg_id", "a", "b")
        clonal = {"is_subclonal": F.lit(False), "is_inconsistent": F.lit(False)} | {c: F.lit(None).cast("double") for c in ("a1", "b1", "tau1", "a2", "b2", "tau2")}
        known = expected_af(mutations.join(states, "seg_id").withColumn("purity", F.lit(purity)).withColumns(clonal))
        rows = written(K.with_fraction(known.where("af_exp is not null").select("mut_key", "af_obs", "af_exp", "coverage")).withColumn("sample_no", F.lit(0)), "fractions")
        quiet = K.quiet(rows, ["sample_no"])
        clusters = written(K.find_clusters(K.fraction_histogram(quiet, ["sample_no"]), K.noise_level(rows, ["sample_no"]), "sample_no"), "clusters")
        assigned = K.assign_clusters(rows, clusters, ["mut_key"], "sample_no").groupBy("cluster_id").agg(F.count("*").alias("n"))
        best = K.largest_clonal(assigned.join(clusters, "cluster_id"), "sample_no").first()
        if best is None:
            raise ValueError("no mutation lies on a segment with known alleles")
        purity = min(1.0, purity * best.ccf)
        scale = ploidy / (2 * purity)
        whole = F.greatest(truncate_half(raw_copies(F.col("cn"), F.lit(purity), F.lit(scale))), F.lit(1))
        ploidy = segments.agg(F.sum(F.col("length") * whole) / F.sum("length")).first()[0]
    return purity, ploidy


def ploidy_summary(segments: DataFrame, *, mode: str = "optimum", sample: str = "sample", sex: str = "m") -> DataFrame:
    """One row: sample_name, purity, ploidy, fraction_subclonal_cn, sex_estimated, status, fraction_inconsistent_segs.

    segments: tid, s_start, s_end, cn, purity, scale, theta_exp, n_snps, is_subclonal, is_inconsistent. Sex chromosomes are left out, and
    segments of negative copies from ploidy; consistent segments of at least 5 sites with an expected imbalance count for the subclonal part.
    """
    rows = segments.where(F.col("tid") < 22).withColumn("length", (F.col("s_end") - F.col("s_start")).cast("double"))
    rows = rows.withColumn("whole", truncate_half(raw_copies(F.col("cn"), F.col("purity"), F.col("scale"))))
    sized = (F.col("n_snps") >= 5) & (F.col("theta_exp") >= 0) & ~F.col("is_inconsistent")
    part = lambda some, of: F.coalesce(F.try_divide(F.sum(F.when(some & of, F.col("length")).otherwise(0.0)), F.sum(F.when(of, F.col("length")))), F.lit(0.0))
    real = F.col("whole") >= 0
    return rows.agg(
        F.lit(sample).alias("sample_name"), F.max("purity").alias("purity"),
        F.try_divide(F.sum(F.when(real, F.col("length") * F.col("whole"))), F.sum(F.when(real, F.col("length")))).alias("ploidy"),
        part(F.col("is_subclonal"), sized).alias("fraction_subclonal_cn"), F.lit(sex).alias("sex_estimated"), F.lit(mode).alias("status"),
        part(F.col("is_inconsistent"), real).alias("fraction_inconsistent_segs"),
    )


def eligible_segments(segments: DataFrame, *, least_snps: int = 100, most_copies: float = 5.0) -> DataFrame:
    """Segments that the fit may use: autosomes with enough sites and not too many copies. segments: tid, cn, n_snps."""
    return segments.where((F.col("n_snps") >= least_snps) & (F.col("tid") < 22) & (F.col("cn") <= most_copies))
