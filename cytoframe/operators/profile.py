"""A sample's copy-number profile: partitions to windows, ratios, segments, and the fit refined in two rounds.

Partitions and sites stay DataFrames; tables of windows and segments, which are small, are written to the shared folder between steps, as the next ones
read them several times. What depends on order is folded over little: partitions of one sample's genome (their number is that
of the assay, whatever the reads), windows of one chromosome, and runs of sites of one chromosome. Purity and ploidy, two numbers, go
through the driver between rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoframe.functions import kernels
from cytoframe.functions.columns import sex_factor, truncate_half
from cytoframe.operators import copynumber as M
from cytoframe.operators.intervals import first_match, forward_fill, islands, number_rows, running_median
from cytoframe.session import written

GC_BINS = 1_000
#: Least informative sites of a segment.
LEAST_SITES = 20


def fold_genome(tid: np.ndarray, size: np.ndarray, reads: np.ndarray, least_length: float, least_reads: float) -> pd.DataFrame:
    """For each partition in genome order: its window, the window its reads count to, whether its GC counts, the length so far, and whether a segment ends with its window.

    A window closes at enough length and normal reads. At a new chromosome an open window with reads closes, yet the first partition of the
    chromosome still belongs to it while its reads count to the next; the length runs on. Without reads the window stays open and that
    partition's GC doesn't count.
    """
    n = len(tid)
    window, counted, with_gc, so_far, ends = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n), np.zeros(n, bool)
    now, length, seen = 0, 0.0, 0.0
    for i in range(n):
        length += size[i]
        window[i], so_far[i] = now, length
        if i and tid[i] != tid[i - 1]:
            ends[i] = True
            if seen > 0:
                now += 1
            else:
                with_gc[i] = False
            seen, counted[i] = reads[i], now
            continue
        counted[i] = now
        seen += reads[i]
        if length >= least_length and seen >= least_reads:
            now, length, seen = now + 1, 0.0, 0.0
    return pd.DataFrame({"window": window, "counted": counted, "with_gc": with_gc, "so_far": so_far, "ends": ends})


def genome_windows(parts: DataFrame, *, least_length: int = 1_000, least_reads: int = 1_000) -> DataFrame:
    """part_no, window, counted, with_gc, so_far, ends for one sample's partitions (tid, part_no, p_start, p_end, n_n)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tid", "p_start", "part_no"], ignore_index=True)
        size = (frame.p_end - frame.p_start + 1).to_numpy(float)
        return frame[["part_no"]].join(fold_genome(frame.tid.to_numpy(), size, frame.n_n.to_numpy(float), least_length, least_reads))

    rows = parts.select("tid", "part_no", "p_start", "p_end", "n_n", F.lit(0).alias("genome"))
    return rows.groupBy("genome").applyInPandas(run, "part_no bigint, window bigint, counted bigint, with_gc boolean, so_far double, ends boolean")


def window_table(parts: DataFrame, windows: DataFrame) -> DataFrame:
    """window, tid (of its first partition), length, n_n, n_t, gc (null where unknown) and arm, the stretch between ends of chromosomes."""
    rows = parts.join(windows, "part_no")
    gc = F.avg(F.when(F.col("with_gc") & (F.col("gc") >= 0), F.col("gc")))
    table = rows.groupBy(F.col("counted").alias("window")).agg(F.min("tid").alias("tid"), F.max("so_far").alias("length"), F.sum("n_n").cast("double").alias("n_n"), F.sum("n_t").cast("double").alias("n_t"), gc.alias("gc"))
    last = windows.where("ends").select("window").distinct().withColumn("_end", F.lit(1))  # an open window ends at every empty chromosome
    ended = F.sum(F.coalesce(F.col("_end"), F.lit(0))).over(W.orderBy("window").rowsBetween(W.unboundedPreceding, -1))
    # one sample's windows, two numbers each
    arms = table.select("window").join(last, "window", "left").select("window", F.coalesce(ended, F.lit(0)).cast("int").alias("arm"))
    return table.join(arms, "window")


def gc_curve(windows: DataFrame, value: str, name: str) -> DataFrame:
    """windows with the smooth median of value at their GC content over the median of all, as name; 1 where GC is unknown.

    Medians of GC bins are smoothed by a spline; its pieces come back as one cubic for each bin, so windows look them up by bin.
    """
    bins = M.gc_bins(windows, value, bins=GC_BINS)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("gc_bin")
        x, y = frame.gc_bin.to_numpy(float) / GC_BINS, frame.median_value.to_numpy(float)
        at = np.arange(GC_BINS + 1) / GC_BINS
        if len(x) < 3:
            cubic = np.zeros((len(at), 4))
            cubic[:, 0] = np.interp(at, x, y)
        else:
            fit, gamma, _ = kernels.smoothing_spline(x, y, frame.weight.to_numpy(float))
            t = np.array([0, 1 / 3, 2 / 3, 1])
            points, _ = kernels.spline_values(x, fit, gamma, (at[:, None] + t / GC_BINS).ravel())
            cubic = np.linalg.solve(np.vander(t, 4, increasing=True), points.reshape(-1, 4).T).T
        return pd.DataFrame({"_bin": np.arange(GC_BINS + 1), **{f"_k{i}": cubic[:, i] for i in range(4)}})

    # at most GC_BINS + 1 rows each way
    curve = bins.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, "_bin int, _k0 double, _k1 double, _k2 double, _k3 double")
    rows = windows.withColumn("_bin", F.floor(F.col("gc") * GC_BINS).cast("int")).withColumn("_t", F.col("gc") * GC_BINS - F.floor(F.col("gc") * GC_BINS))
    level = F.col("_k0") + F.col("_t") * (F.col("_k1") + F.col("_t") * (F.col("_k2") + F.col("_t") * F.col("_k3")))
    middle = windows.agg(F.median(value)).first()[0]  # one number
    joined = rows.join(F.broadcast(curve), "_bin", "left").withColumn(name, F.coalesce(level / middle, F.lit(1.0)))
    return joined.drop("_bin", "_t", "_k0", "_k1", "_k2", "_k3")


def window_ratios(windows: DataFrame, totals: dict, *, smooth: int = 2) -> DataFrame:
    """windows with ratio (tumour over normal reads, corrected for GC and sequencing depth) and noise, its variance."""
    rows = gc_curve(gc_curve(windows, "n_n", "gc_n"), "n_t", "gc_t")
    step = lambda df: written(df, "windows")
    rows = rows.withColumn("density", F.col("n_n") / F.col("length")).withColumn("n_t", F.col("n_t") * totals["ratio_n_t"] * F.col("gc_n") / F.col("gc_t"))
    rows = step(rows)
    at = windows.agg(F.count("*").alias("n"), F.avg(F.col("n_n") / F.col("length")).alias("density")).first()
    if smooth:
        for column in ("n_t", "n_n"):
            rows = step(running_median(rows, column, ordinal="window", half=smooth, n=at.n).drop(column).withColumnRenamed(f"{column}_median", column))
    rows = rows.withColumn("ratio", F.try_divide(F.col("n_t"), F.col("n_n")))
    if smooth:
        rows = running_median(rows, "ratio", ordinal="window", half=1, n=at.n).drop("ratio").withColumnRenamed("ratio_median", "ratio")
    share = F.col("length") / totals["genome_size"] * totals["reads_n"] * (F.col("n_n") / F.col("length")) / at.density
    return rows.withColumn("noise", F.try_divide(1 + F.col("ratio"), share))


def _segmented(rows: DataFrame, kernel, value: str, noise: str, group: str, alpha: float, least: int, opens: bool) -> DataFrame:
    """window, segment (its first window) by a kernel over the windows of each group; forced windows end a segment, opens as the kernel takes it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("window", ignore_index=True)
        known = frame.x.notna().to_numpy()
        out = frame.window.to_numpy().copy()
        at = np.flatnonzero(known)
        if len(at):
            place = {w: i for i, w in enumerate(frame.window[at])}
            forced = tuple(place[w] for w in frame.window[frame.forced] if w in place)
            for a, b in kernel(frame.x.to_numpy(float)[at], frame.noise.to_numpy(float)[at], alpha, least, forced, opens=opens, from_start=frame.window[0] == 0):
                out[at[a] : at[b] + 1] = out[at[a]]
        return pd.DataFrame({"window": frame.window, "segment": out})

    part = rows.select(F.col(group).alias("_group"), "window", F.col(value).alias("x"), F.coalesce(F.col(noise), F.lit(0.0)).alias("noise"), "forced")
    return part.groupBy("_group").applyInPandas(run, "window bigint, segment bigint")


def copy_number_profile(parts: DataFrame, *, least_length: int = 1_000, least_reads: int = 1_000, smooth: int = 2, alpha: float = 0.001, least: int = 2, breaks: DataFrame | None = None, opens: bool = True) -> DataFrame:
    """parts (tid, part_no, p_start, p_end, gc, n_t, n_n) of one sample with window, segment, cn_coarse and cn.

    breaks (tid, pos): places of structural variants, whose windows end a segment. Windows are cut into segments of their ratios, then,
    within these, of the logarithms of ratios with a noise that depends on GC content. opens: each part that a pass of splitting begins with opens with a segment of
    one window, but for the genome's first; False leaves that out.
    """
    totals = M.genome_totals(parts).first().asDict()
    assigned = written(genome_windows(parts, least_length=least_length, least_reads=least_reads), "assigned")
    rows = written(window_ratios(written(window_table(parts, assigned), "windows"), totals, smooth=smooth), "ratios")
    if breaks is None:
        rows = rows.withColumn("forced", F.lit(False))
    else:
        points = breaks.select("tid", "pos").distinct().withColumn("k", F.monotonically_increasing_id())
        hit = first_match(points, parts, key=["k"], group="tid", at="pos", begin="p_start", end="p_end", ordinal="part_no", width=1 << 20)
        forced = hit.join(assigned, "part_no").select("window", F.lit(True).alias("forced")).distinct()
        rows = rows.join(forced, "window", "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    first = written(rows.join(_segmented(rows, kernels.binary_segments, "ratio", "noise", "arm", alpha, least, opens), "window"), "segments")
    mean = F.avg("ratio").over(W.partitionBy("segment"))
    first = first.withColumn("mean_coarse", mean).withColumn("residual", F.when((F.col("ratio") > 0) & (F.col("mean_coarse") > 0), F.ln(F.col("ratio") / F.col("mean_coarse"))))
    varied = M.gc_variance(first.where("residual is not null"), "residual").select("gc_bin", "variance")
    first = written(first.withColumn("gc_bin", F.floor(F.col("gc") * 100).cast("int")).join(F.broadcast(varied), "gc_bin", "left").withColumn("log_ratio", F.when(F.col("ratio") > 0, F.ln("ratio"))), "segments")
    second = _segmented(first, kernels.flank_segments, "log_ratio", "variance", "segment", alpha, least, opens).withColumnRenamed("segment", "fine")
    both = first.join(second, "window").withColumn("mean_fine", F.avg("ratio").over(W.partitionBy("fine")))
    sex = sex_factor(F.col("tid"), F.lit(totals["sex"]))
    out = parts.join(assigned.select("part_no", "window"), "part_no").join(both.select("window", "mean_coarse", F.col("fine").alias("segment"), "mean_fine"), "window", "left")
    return out.withColumn("cn_coarse", 2 * sex * F.col("mean_coarse")).withColumn("cn", 2 * sex * F.col("mean_fine")).drop("mean_coarse", "mean_fine")


def site_segments(sites: DataFrame, parts: DataFrame, value: str, *, least: int = LEAST_SITES) -> DataFrame:
    """seg_id, tid, s_start, s_end, length, cn, n_snps, theta, theta_sigma: runs of sites over partitions of equal value, as ``fold_runs`` joins them.

    sites: tid, pos, part_no, t_a, t_b, n_a, n_b; parts: part_no, p_start, p_end and value. Sites are counted to runs before these are folded in genome order (their
    number is at most that of partitions, and ``least`` more a chromosome, whose first informative sites are told apart as a segment of the one before may end there).
    """
    order = ["pos", "part_no", "t_a", "t_b", "n_a", "n_b"]
    placed = sites.join(parts.where(F.col(value).isNotNull()).select("part_no", "p_start", "p_end", F.col(value).alias("cn")), "part_no").withColumn("informative", M.is_heterozygous().cast("int"))
    final = placed.agg(F.max(F.struct("tid", *order)).alias("x")).select("x.*").first()
    ahead = W.partitionBy("tid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    first = F.least(F.coalesce(F.sum("informative").over(ahead), F.lit(0)), F.lit(least))
    is_last = F.lit(True)
    for c in ("tid", *order):
        is_last = is_last & F.col(c).eqNullSafe(F.lit(final[c]))
    runs = islands(placed.withColumn("first", first).withColumn("final", is_last), group=["tid"], order=order, by=["cn", "first", "final"])
    short = runs.groupBy("tid", "run", "cn").agg(F.sum("informative").alias("n"), F.count("*").alias("sites"), F.min_by("p_start", F.struct(*order)).alias("begin"), F.max_by("p_end", F.struct(*order)).alias("end"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tid", "run"], ignore_index=True)
        found, number = kernels.fold_runs(*(frame[c].to_numpy() for c in ("tid", "cn", "n", "sites", "begin", "end")), least)
        rows = frame[["tid", "run"]].assign(seg=number)[number >= 0]
        facts = pd.DataFrame(found, columns=["seg_tid", "s_start", "s_end", "seg_cn", "n_seg"]).astype({"seg_tid": int, "s_start": int, "s_end": int, "seg_cn": float, "n_seg": int})
        return rows.merge(facts, left_on="seg", right_index=True)

    one = short.withColumn("genome", F.lit(0)).groupBy("genome")
    merged = one.applyInPandas(fold, "tid int, run bigint, seg bigint, seg_tid int, s_start bigint, s_end bigint, seg_cn double, n_seg bigint")
    facts = merged.select("seg", F.col("seg_tid").alias("tid"), "s_start", "s_end", F.col("seg_cn").alias("cn")).distinct()
    theta = M.imbalance_by(runs.where("informative = 1").select("tid", "run", "t_a", "t_b").join(merged.select("tid", "run", "seg"), ["tid", "run"]), ["seg"])
    rows = facts.join(theta, "seg").withColumn("length", (F.col("s_end") - F.col("s_start")).cast("double"))
    return rows.select(F.col("seg").alias("seg_id"), "tid", "s_start", "s_end", "length", "cn", "n_snps", "theta", "theta_sigma")


@dataclass(frozen=True)
class Fit:
    purity: float
    ploidy: float
    mode: str = "optimum"

    @property
    def scale(self) -> float:
        return self.ploidy / (2 * self.purity)


def fit_segments(segments: DataFrame, sigma: float, *, purities: list[float], ploidies: list[float], least_snps: int = 100) -> Fit | None:
    """Purity and ploidy of the segments that may be used, None without any."""
    usable = M.eligible_segments(segments, least_snps=least_snps)
    best = M.best_fit(M.fit_grid(usable, purities, ploidies, sigma)).first()
    return Fit(best.purity, best.ploidy) if best else None


def states_of(segments: DataFrame, fit: Fit, sigma: float) -> DataFrame:
    """segments with alleles, subclonal test and two-clone states at a fit."""
    rows = segments.withColumn("purity", F.lit(fit.purity)).withColumn("scale", F.lit(fit.scale))
    states = M.allele_states(rows, ["seg_id"], sigma).select("seg_id", "icn", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "theta_exp")
    return M.two_clones(M.subclonal_test(rows.join(states, "seg_id")), sigma)


def aggregated_copies(parts: DataFrame, states: DataFrame, fit: Fit) -> DataFrame:
    """parts with cn_aggregated: the mean copies over runs of partitions that have one state, expected imbalance and whole copies.

    A partition has the state of the segment it lies in; one in none has that of the partition before.
    """
    held = first_match(parts.select("tid", "part_no", "p_start"), states, key=["part_no"], group="tid", at="p_start", begin="s_start", end="s_end", ordinal="seg_id", width=1 << 20)
    marked = parts.join(held, "part_no").join(states.select("seg_id", "theta_exp", F.col("is_subclonal").cast("int").alias("_sub")), "seg_id", "left")
    marked = forward_fill(forward_fill(marked, "theta_exp", group=["tid"], order=["part_no"]), "_sub", group=["tid"], order=["part_no"])
    marked = marked.withColumn("_whole", truncate_half(M.raw_copies(F.col("cn"), F.lit(fit.purity), F.lit(fit.scale))))
    runs = islands(marked, group=["tid"], order=["part_no"], by=["theta_exp", "_sub", "_whole"])
    return runs.withColumn("cn_aggregated", F.avg("cn").over(W.partitionBy("tid", "run"))).drop("seg_id", "theta_exp", "_sub", "_whole", "run")


def refined_fit(parts: DataFrame, sites: DataFrame, sigma: float, *, purities: list[float], ploidies: list[float], least_snps: int = 100, mutations: DataFrame | None = None, forced: bool = False) -> tuple[Fit, DataFrame, DataFrame]:
    """The fit in two rounds: (fit, segments with their states, parts with cn_aggregated).

    Coarse copies give the first fit; where it ends at the least purity of all (or is forced) purity and ploidy come from mutations
    (mut_key, tid, pos, af_obs, coverage). Fine copies then give states, whose runs of partitions give the copies of the second fit.
    """
    coarse = written(site_segments(sites, parts, "cn_coarse"), "site-segments")
    fit = fit_segments(coarse, sigma, purities=purities, ploidies=ploidies, least_snps=least_snps)
    if fit is None:
        raise ValueError("no segment has enough sites for a fit")
    if forced or fit.purity == purities[0]:
        if mutations is None:
            raise ValueError("copies don't tell purity, and there are no mutations to take it from")
        placed = written(first_match(mutations, coarse, key=["mut_key", "af_obs", "coverage"], group="tid", at="pos", begin="s_start", end="s_end", ordinal="seg_id", width=1 << 20), "placed")
        purity, ploidy = M.refine_purity(coarse, placed, sigma=sigma, ploidy=ploidies[0])
        fit = Fit(purity, ploidy, "forced" if forced else "invariant")
    fine = written(states_of(site_segments(sites, parts, "cn"), fit, sigma), "states")
    joined = written(aggregated_copies(parts, fine, fit), "copies")
    segments = written(site_segments(sites, joined, "cn_aggregated"), "site-segments")
    again = fit_segments(segments, sigma, purities=purities, ploidies=ploidies, least_snps=least_snps) or fit
    fit = Fit(again.purity, again.ploidy, fit.mode)
    return fit, written(states_of(segments, fit, sigma), "states"), joined


# --- the tables that a run leaves ---


def states_table(states: DataFrame, sample: str) -> DataFrame:
    """Allelic states, 15 columns: segments with an expected imbalance, but for chromosome X."""
    rows = states.where("n_snps >= 1 and theta_exp >= 0 and tid <> 22")
    flag = lambda c: c.cast("int")
    return rows.select(
        F.lit(sample).alias("Sample"), chromosome_name(F.col("tid")).alias("Chromosome"), F.col("s_start").alias("Start"), F.col("s_end").alias("End"),
        M.raw_copies(F.col("cn"), F.col("purity"), F.col("scale")).alias("Copy_Nr_Raw"), F.col("icn").alias("CopyNr"), F.col("a").alias("A"), F.col("b").alias("B"), flag(F.col("b") == 0).alias("LOH"),
        F.col("theta").alias("Theta"), F.col("theta_exp").alias("Theta_Exp"), F.col("n_snps").alias("n_SNPs"), flag(F.col("is_subclonal")).alias("Is_Subclonal_CN"), F.col("p_subclonal").alias("Subclonal_P_value"),
        flag(F.col("is_inconsistent")).alias("Is_Inconsistent_State"),
    )


def subclonal_table(states: DataFrame, sample: str) -> DataFrame:
    """Segments of two clones, 11 columns: autosomes only."""
    rows = states.where("is_subclonal and not is_inconsistent and tid < 22")
    total = (F.col("a1") + F.col("b1")) * F.col("tau1") + (F.col("a2") + F.col("b2")) * F.col("tau2")
    names = {"a1": "Clone1_A", "b1": "Clone1_B", "tau1": "Clone1_Fraction", "a2": "Clone2_A", "b2": "Clone2_B", "tau2": "Clone2_Fraction"}
    return rows.select(F.lit(sample).alias("Sample"), chromosome_name(F.col("tid")).alias("Chromosome"), F.col("s_start").alias("Start"), F.col("s_end").alias("End"), total.alias("Subclonal_CN"), *[F.col(k).alias(v) for k, v in names.items()])


def expected_table(mutations: DataFrame, sample: str, *, alleles: bool = False) -> DataFrame:
    """Expected frequencies of mutations, 13 columns, and 8 more with alleles.

    mutations: tid, pos, ref, alt, af_obs, coverage and the state of their segment (as ``expected_af`` takes it). Changes of several bases into
    several are left out, and mutations without an expected frequency. Of a segment of two clones A and B are -1, of another the clones'.
    """
    from cytoframe.sources.text import mutation_id

    rows = M.expected_af(mutations).where("af_exp is not null")
    _, p = M.cell_fraction(F.col("af_obs"), F.col("af_exp"), F.col("coverage"))
    name = chromosome_name(F.col("tid"))
    key = mutation_id(F.concat(F.lit(f"{sample}_"), name, F.lit(":"), F.col("pos").cast("string")), F.col("ref"), F.col("alt"))
    columns = [
        key.alias("Mut_ID"), name.alias("Chr"), F.col("pos").alias("Position"), F.col("ref").alias("Wt"), F.col("alt").alias("Mut"), F.col("af_obs").alias("AF_obs"), F.col("coverage").alias("Coverage"),
        F.col("af_exp").alias("AF_exp"), F.col("copies").alias("Mut_Copies"), F.col("copies_raw").alias("Mut_Copies_Raw"), F.col("is_subclonal").cast("int").alias("Is_Subclonal_CN"), F.col("icn").alias("iCN"), p.alias("P_Is_Clonal"),
    ]
    if alleles:
        mixed = F.col("is_subclonal") & ~F.col("is_inconsistent")
        own = lambda c, alone: F.when(mixed, F.lit(-1) if alone else F.col(c)).otherwise(F.col(c) if alone else F.lit(-1))
        names = {"a": "CN_A", "b": "CN_B", "tau1": "tau1", "a1": "CN_Clone1_A", "b1": "CN_Clone1_B", "tau2": "tau2", "a2": "CN_Clone2_A", "b2": "CN_Clone2_B"}
        columns += [own(k, k in ("a", "b")).alias(v) for k, v in names.items()]
    return rows.select(*columns).where("Mut_ID is not null")


def phylogeny_table(mutations: DataFrame, sample: str) -> DataFrame:
    """id (s0, s1, ... by place), gene, a (reference reads), d, mu_r, mu_v of single-base mutations with an expected frequency."""
    rows = M.expected_af(mutations).where("af_exp is not null and length(ref) = 1 and length(alt) = 1")
    rows = number_rows(rows, group="tid", at="pos", order=["ref", "alt"], width=1 << 20, name="_number")
    reference = (F.col("coverage") * (1 - F.col("af_obs")) + 0.1).cast("bigint")
    name = F.concat(F.lit(f"{sample}_"), chromosome_name(F.col("tid")), F.lit(":"), F.col("pos").cast("string"), F.lit("_SNM"))
    return rows.select(F.concat(F.lit("s"), F.col("_number").cast("string")).alias("id"), name.alias("gene"), reference.alias("a"), F.col("coverage").alias("d"), F.lit(0.999).alias("mu_r"), (1 - F.col("af_exp")).alias("mu_v"))


def chromosome_name(tid):
    """chr1 to chr22, chrX and chrY for 0 to 23."""
    return F.when(tid < 22, F.concat(F.lit("chr"), (tid + 1).cast("string"))).when(tid == 22, "chrX").otherwise("chrY")
