"""Clusters of mutations by the fraction of cancer cells that carry them.

The histogram and the assignment are DataFrame expressions over all mutations; only the histogram of a sample (a fixed
number of bins) goes through a grouped function that removes the noise and finds the peaks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoframe.functions.columns import normal_cdf
from cytoframe.functions.kernels import deconvolve, density_peaks

#: Fractions that the histogram covers.
#: Clusters of all samples that are broadcast; more are joined by a shuffle.
MOST_CLUSTERS = 100_000
TOP = 1.5


def with_fraction(mutations: DataFrame) -> DataFrame:
    """mutations (af_obs, af_exp, coverage) with ccf and its deviation sd; null where nothing is expected."""
    ccf = F.try_divide(F.col("af_obs"), F.col("af_exp"))
    return mutations.withColumn("ccf", ccf).withColumn("sd", F.sqrt(F.try_divide(F.col("ccf") * (1 - F.col("af_obs")), F.col("coverage") * F.col("af_exp"))))


def noise_level(mutations: DataFrame, by: list[str]) -> DataFrame:
    """by, mean, population deviation and median of sd over mutations whose fraction the histogram covers."""
    inside = mutations.where((F.col("ccf") >= 0) & (F.col("ccf") < TOP))
    return inside.groupBy(*by).agg(F.avg("sd").alias("sd_mean"), F.stddev_pop("sd").alias("sd_pop"), F.median("sd").alias("sd_median"))


def quiet(mutations: DataFrame, by: list[str]) -> DataFrame:
    """Mutations within the histogram whose sd is at most the median and half a deviation, with the sample's noise columns."""
    joined = mutations.where((F.col("ccf") >= 0) & (F.col("ccf") < TOP)).join(F.broadcast(noise_level(mutations, by)), by)  # a row for each sample
    return joined.where(F.col("sd") <= F.col("sd_median") + 0.5 * F.col("sd_pop"))


def fraction_histogram(mutations: DataFrame, by: list[str], bins: int = 100) -> DataFrame:
    """by, bin, n and density (integral 1 over [0, TOP)) for every bin of every sample."""
    inside = mutations.where((F.col("ccf") >= 0) & (F.col("ccf") < TOP)).withColumn("bin", F.floor(F.col("ccf") * (bins / TOP)).cast("int"))
    counts = inside.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    every = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy(*by))
    return full.withColumn("density", F.col("n") / (total * (TOP / bins)))


def find_clusters(histogram: DataFrame, noise: DataFrame, by: str, *, bins: int = 100, penalty: float = 1e-7) -> DataFrame:
    """by, cluster_id (0: the largest fraction), ccf of the peaks below 1 and the noise deviation."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        edges = np.linspace(0, TOP, bins + 1)
        sigma = float(frame.sd_median.iloc[0]) or 1e-3
        x, g, gamma = deconvolve(edges, frame.density.to_numpy(), sigma, penalty)
        peaks = [p for p in density_peaks(x, g, gamma) if p < 1 + sigma] or [float((frame.density * x).sum() / max(frame.density.sum(), 1e-12))]
        return pd.DataFrame({by: frame[by].iloc[0], "cluster_id": range(len(peaks)), "ccf": peaks})

    kind = histogram.schema[by].dataType.simpleString()
    return histogram.join(noise.select(by, "sd_median"), by).groupBy(by).applyInPandas(run, f"{by} {kind}, cluster_id int, ccf double")


def assign_clusters(mutations: DataFrame, clusters: DataFrame, keys: list[str], by: str) -> DataFrame:
    """keys, cluster_id, cluster_prob, p (probabilities by cluster): the cluster whose noise explains a mutation best.

    The first and last cluster are open to their sides. A mutation of observed frequency 1 goes to cluster 0 for sure.
    """
    from cytoframe.functions.columns import erf

    n = F.count("*").over(W.partitionBy(by))
    found = clusters.withColumn("n_clusters", n).withColumnRenamed("ccf", "peak")
    few = clusters.limit(MOST_CLUSTERS + 1).count() <= MOST_CLUSTERS
    each = mutations.join(F.broadcast(found) if few else found, by)
    d = F.col("ccf") - F.col("peak")
    two = 1 - erf(F.abs(d) / (F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")) * 2**0.5))
    high, low = normal_cdf(d, F.col("sd")), normal_cdf(-d, F.col("sd"))
    w = F.when(F.col("n_clusters") == 1, 1.0).when(F.col("cluster_id") == 0, high).when(F.col("cluster_id") == F.col("n_clusters") - 1, low).otherwise(two)
    weighed = each.withColumn("w", F.when(F.col("af_obs") == 1, (F.col("cluster_id") == 0).cast("double")).otherwise(w))
    rows = F.array_sort(F.collect_list(F.struct("cluster_id", "w")))
    out = weighed.groupBy(*keys).agg(rows.alias("r"), F.sum("w").alias("total"), F.max(F.struct("w", (-F.col("cluster_id")).alias("c"))).alias("best"))
    share = lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(0.0)
    return out.select(*keys, (-F.col("best.c")).alias("cluster_id"), share(F.col("best.w")).alias("cluster_prob"), F.transform("r", lambda x: share(x["w"])).alias("p"))


def largest_clonal(sizes: DataFrame, by: str, least: float = 0.05) -> DataFrame:
    """by, the largest fraction among clusters with over ``least`` of a sample's mutations. sizes: by, cluster_id, ccf, n."""
    total = F.sum("n").over(W.partitionBy(by))
    return sizes.withColumn("_total", total).where(F.col("n") > least * F.col("_total")).groupBy(by).agg(F.max("ccf").alias("ccf"))
