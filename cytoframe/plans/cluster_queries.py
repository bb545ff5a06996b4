"""Queries of mutation clustering, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.functions.columns import erf_sql
from cytoframe.operators import clustering as K
from cytoframe.plans.adapters import mutations, with_views

PEAKS = [(0, 0.95), (1, 0.55), (2, 0.25)]


def _mutations(spark: SparkSession, d: str) -> DataFrame:
    rows = mutations(spark, d).select("mut_key", (F.col("tid") % 4).alias("sample_no"), (F.col("af") * 0.5).alias("af_obs"), (0.35 + (F.col("mut_key") % 5) * 0.03).alias("af_exp"), F.col("dp").alias("coverage"))
    return K.with_fraction(rows)


_MUT = """, x as (select mut_key, tid % 4 as sample_no, af * cast(0.5 as double) as af_obs, cast(0.35 as double) + (mut_key % 5) * cast(0.03 as double) as af_exp, dp as coverage from mutations),
 m as (select *, af_obs / af_exp as ccf, sqrt(af_obs / af_exp * (1 - af_obs) / (coverage * af_exp)) as sd from x)"""


def noise(spark: SparkSession, d: str) -> DataFrame:
    out = K.noise_level(_mutations(spark, d), ["sample_no"])
    return out.select("sample_no", *[F.round(c, 9).alias(c) for c in ("sd_mean", "sd_pop", "sd_median")])


NOISE = with_views("mutations") + _MUT + " select sample_no, round(avg(sd), 9) as sd_mean, round(stddev_pop(sd), 9) as sd_pop, round(median(sd), 9) as sd_median from m where ccf >= 0 and ccf < 1.5 group by sample_no"


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return K.fraction_histogram(K.quiet(_mutations(spark, d), ["sample_no"]), ["sample_no"], 50).withColumn("density", F.round("density", 9))


HISTOGRAM = (
    with_views("mutations")
    + _MUT
    + """, n as (select sample_no, stddev_pop(sd) as p, median(sd) as md from m where ccf >= 0 and ccf < 1.5 group by sample_no), q as (select m.* from m join n using (sample_no) where sd <= md + cast(0.5 as double) * p),
 h as (select sample_no, cast(floor(ccf * cast(33.333333333333336 as double)) as int) as bin, count(*) as n from q where ccf >= 0 and ccf < 1.5 group by all),
 f as (select s.sample_no, b.bin, coalesce(h.n, 0) as n from (select distinct sample_no from h) s cross join (select cast(unnest(range(50)) as int) as bin) b left join h on h.sample_no = s.sample_no and h.bin = b.bin)
 select sample_no, bin, n, round(n / (sum(n) over (partition by sample_no) * cast(0.03 as double)), 9) as density from f"""
)


def assigned(spark: SparkSession, d: str) -> DataFrame:
    rows = _mutations(spark, d)
    clusters = spark.createDataFrame([(s, c, p) for s in range(4) for c, p in PEAKS], "sample_no int, cluster_id int, ccf double")
    return K.assign_clusters(rows, clusters, ["mut_key"], "sample_no")


def assignment(spark: SparkSession, d: str) -> DataFrame:
    return assigned(spark, d).select("mut_key", "cluster_id", F.round("cluster_prob", 6).alias("cluster_prob"), F.round(F.get("p", F.lit(0)), 6).alias("p0"))


_CDF = lambda x: f"((1 + {erf_sql(f'(({x}) / (sd * sqrt(cast(2 as double))))')}) / 2)"
ASSIGNMENT = (
    with_views("mutations")
    + _MUT
    + ", c as (select * from (values "
    + ", ".join(f"({c}, cast({p} as double))" for c, p in PEAKS)
    + ") c(cluster_id, peak)), w as (select mut_key, cluster_id, case when af_obs = 1 then case cluster_id when 0 then 1 else 0 end when cluster_id = 0 then "
    + _CDF("ccf - peak")
    + " when cluster_id = 2 then "
    + _CDF("peak - ccf")
    + " else 1 - "
    + erf_sql("(abs(ccf - peak) / (sd * sqrt(cast(2 as double))))")
    + """ end as w from m cross join c),
 s as (select *, sum(w) over (partition by mut_key) as t, first_value(w) over (partition by mut_key order by cluster_id) as w0, row_number() over (partition by mut_key order by w desc, cluster_id) as k from w)
 select mut_key, cluster_id, round(w / t, 6) as cluster_prob, round(w0 / t, 6) as p0 from s where k = 1"""
)


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return assigned(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"))


CLUSTER_SIZES = ASSIGNMENT.replace("select mut_key, cluster_id, round(w / t, 6) as cluster_prob, round(w0 / t, 6) as p0 from s where k = 1", "select cluster_id, count(*) as n from s where k = 1 group by cluster_id")


def largest_clonal(spark: SparkSession, d: str) -> DataFrame:
    peaks = spark.createDataFrame(PEAKS, "cluster_id int, ccf double")
    sizes = assigned(spark, d).join(mutations(spark, d).select("mut_key", (F.col("tid") % 4).alias("sample_no")), "mut_key").groupBy("sample_no", "cluster_id").agg(F.count("*").alias("n"))
    return K.largest_clonal(sizes.join(peaks, "cluster_id"), "sample_no")


LARGEST_CLONAL = ASSIGNMENT.replace(
    "select mut_key, cluster_id, round(w / t, 6) as cluster_prob, round(w0 / t, 6) as p0 from s where k = 1",
    """, z as (select sample_no, cluster_id, count(*) as n from s join m using (mut_key) where k = 1 group by all), y as (select *, sum(n) over (partition by sample_no) as total from z)
 select sample_no, max(peak) as ccf from y join c using (cluster_id) where n > cast(0.05 as double) * total group by sample_no""",
)


def clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = _mutations(spark, d)
    hist = K.fraction_histogram(K.quiet(rows, ["sample_no"]), ["sample_no"], 100)
    return K.find_clusters(hist, K.noise_level(rows, ["sample_no"]), "sample_no")


QUERIES = {
    "a20_noise": (noise, NOISE),
    "a19_histogram": (histogram, HISTOGRAM),
    "k6_assignment": (assignment, ASSIGNMENT),
    "a21_cluster_sizes": (cluster_sizes, CLUSTER_SIZES),
    "a22_largest_clonal": (largest_clonal, LARGEST_CLONAL),
    "k2_clusters": (clusters, None),
}
