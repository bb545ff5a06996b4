"""A made-up sample through the whole profile: windows, ratios, segments, the two rounds of the fit, and the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.operators import copynumber as M
from cytoframe.operators import profile

PURITY = 0.7
#: Copies A, B of three stretches of each of four chromosomes.
STATES = [[(1, 1), (2, 1), (1, 1)], [(2, 1), (1, 1), (1, 0)], [(1, 1), (1, 1), (2, 2)], [(1, 0), (1, 1), (2, 1)]]
PARTS = 240


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    parts, sites = [], []
    copies = [sum(s) for c in STATES for s in c]
    ploidy = PURITY * np.mean(copies) + 2 * (1 - PURITY)
    for tid, stretches in enumerate(STATES):
        for i in range(PARTS):
            a, b = stretches[i * 3 // PARTS]
            part, gc = tid * PARTS + i, 0.3 + 0.2 * rng.random()
            depth = 4_000 * (1 + 0.5 * (gc - 0.4))
            cells = PURITY * (a + b) + 2 * (1 - PURITY)
            parts.append((tid, part, i * 1000 + 1, i * 1000 + 1000, float(gc), int(rng.poisson(depth * cells / ploidy)), int(rng.poisson(depth))))
            for k in range(6):
                share = (PURITY * a + 1 - PURITY) / cells
                share = share if rng.random() < 0.5 else 1 - share
                t, n = int(rng.binomial(200, share)), int(rng.binomial(200, 0.5))
                sites.append((tid, i * 1000 + 10 + k * 100, part, t, 200 - t, n, 200 - n))
    p = spark.createDataFrame(parts, "tid int, part_no bigint, p_start bigint, p_end bigint, gc double, n_t bigint, n_n bigint")
    s = spark.createDataFrame(sites, "tid int, pos bigint, part_no bigint, t_a bigint, t_b bigint, n_a bigint, n_b bigint")
    return p, s


def test_fit_finds_the_sample(spark, sample, tmp_path):
    parts, sites = sample
    found = profile.copy_number_profile(parts, least_length=2_000, least_reads=5_000)
    found.write.parquet(f"{tmp_path}/parts")
    cut = spark.read.parquet(f"{tmp_path}/parts")
    assert cut.count() == 4 * PARTS
    # copies change where they were made to
    ends = cut.where("cn is not null").groupBy("segment").agg(F.min("part_no").alias("a"), F.count("*").alias("n")).orderBy("a").collect()
    for tid, stretches in enumerate(STATES):
        for k in (1, 2):
            if sum(stretches[k]) != sum(stretches[k - 1]):
                assert min(abs(e.a - tid * PARTS - k * PARTS // 3) for e in ends) <= 8, (tid, k)
    sigma = M.folded_sigma(sites.withColumn("one", F.lit(0)), ["one"], 1.0).first().sigma
    purities = [0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9]
    fit, states, joined = profile.refined_fit(cut, sites, sigma, purities=purities, ploidies=[1.6 + 0.05 * k for k in range(25)], least_snps=50)
    assert fit.purity == pytest.approx(PURITY, abs=0.051) and fit.mode == "optimum"
    rows = states.collect()
    # most of the genome has the alleles it was made with
    right = total = 0
    for r in rows:
        for part in range(int(r.s_start) // 1000, int(r.s_end) // 1000):
            total += 1
            right += (r.a, r.b) == STATES[r.tid][min(2, part * 3 // PARTS)]
    assert right / total > 0.9
    table = profile.states_table(states, "s")
    assert table.columns[:4] == ["Sample", "Chromosome", "Start", "End"] and len(table.columns) == 15 and table.count() == len(rows)
    summary = M.ploidy_summary(states, mode=fit.mode, sample="s").first()
    assert summary.status == "optimum" and 1.5 < summary.ploidy < 3.5
    assert joined.where("cn_aggregated is not null").count() > 0


def test_forced_windows_end_segments(spark, sample):
    parts, _ = sample
    breaks = spark.createDataFrame([(0, 40_500)], "tid int, pos bigint")
    found = profile.copy_number_profile(parts, least_length=2_000, least_reads=5_000, breaks=breaks)
    rows = {r.part_no: r for r in found.where("tid = 0").collect()}
    assert rows[30].segment != rows[50].segment
    assert profile.copy_number_profile(parts.limit(0), least_length=2_000, least_reads=5_000).count() == 0


def test_empty_chromosomes_make_no_further_windows(spark):
    empty = {0, 1, 4, 5, 6, 9}
    rows = [(t, t * 20 + i, i * 1000 + 1, i * 1000 + 1000, 0.4, 0 if t in empty else 50 + i, 0 if t in empty else 40 + t) for t in range(10) for i in range(20)]
    parts = spark.createDataFrame(rows, "tid int, part_no bigint, p_start bigint, p_end bigint, gc double, n_t bigint, n_n bigint")
    windows = profile.genome_windows(parts, least_length=3_000, least_reads=100)
    table = profile.window_table(parts, windows)
    assert table.count() == table.select("window").distinct().count() == windows.select("counted").distinct().count()
    cut = profile.copy_number_profile(parts, least_length=3_000, least_reads=100, least=2)
    assert cut.count() == len(rows) and cut.select("part_no").distinct().count() == len(rows)
