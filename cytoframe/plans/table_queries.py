"""Queries of output tables and small choices on rows, and the same in DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoframe.functions import columns as C
from cytoframe.operators import copynumber as M
from cytoframe.operators import pileup
from cytoframe.operators import reads as R
from cytoframe.operators import reports as T
from cytoframe.plans.adapters import TIES, base_arrays, partitions, reads, reference_arrays, snps, with_views
from cytoframe.plans.interval_queries import _COUNTS, _counts
from cytoframe.plans.model_queries import _NAME
from cytoframe.plans.read_queries import ID


def read_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.read_count_table(_counts(spark, d).withColumn("gc", F.col("gc_permille") / 1000.0))


READ_COUNTS = with_views("reads", "partitions") + _COUNTS + f' select {_NAME} as chromosome, p_start as start, p_end as "end", n_t as rcount_t, n_n as rcount_n, gc_permille / cast(1000 as double) as "GC" from counts'


def snp_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = snps(spark, d).select("tid", F.floor((F.col("pos") - 1) / 1000).alias("local_no"), "pos", "t_a", F.col("t_b").alias("t_c"), F.lit(0).alias("t_g"), F.lit(1).alias("t_t"), "n_a", F.col("n_b").alias("n_c"), F.lit(0).alias("n_g"), F.lit(1).alias("n_t"), (F.col("pos") % 4).alias("allele_a"), ((F.col("pos") + 1) % 4).alias("allele_b"))
    return T.snp_table(rows, partitions(spark).where("tid % 5 <> 2 or bin < 300"))


SNP_ROWS = (
    with_views("snps", "partitions")
    + f""", o as (select tid, cast(coalesce(sum(n) over (order by tid rows between unbounded preceding and 1 preceding), 0) as bigint) as o from (select tid, count(*) as n from partitions where tid % 5 <> 2 or bin < 300 group by tid))
 select (pos - 1) // 1000 + o as part_no, {_NAME} as chromosome, pos as position, t_a as "T_A", t_b as "T_C", 0 as "T_G", 1 as "T_T", n_a as "N_A", n_b as "N_C", 0 as "N_G", 1 as "N_T", pos % 4 as "allele_A", (pos + 1) % 4 as "allele_B" from snps join o using (tid)"""
)


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    return T.segment_table(_counts(spark, d).withColumn("cn", F.least(F.col("n_t"), F.lit(2)) / 2.0).where("tid < 22"), "s1", "cn")


SEGMENT_ROWS = (
    with_views("reads", "partitions")
    + _COUNTS
    + f""", x as (select *, least(n_t, 2) / cast(2 as double) as cn from counts where tid < 22), y as (select *, case when lag(cn) over w is null or lag(cn) over w = cn then 0 else 1 end as f from x window w as (partition by tid order by part_no)),
 z as (select *, sum(f) over (partition by tid order by part_no) as run from y) select 's1' as "ID", {_NAME} as chrom, min(p_start) as start, max(p_end) as "end", count(*) as n, cn as value from z group by tid, run, cn"""
)


def cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    from cytoframe.plans import cluster_queries as Q

    rows = Q._mutations(spark, d)
    clusters = spark.createDataFrame([(s, c, p) for s in range(4) for c, p in Q.PEAKS], "sample_no int, cluster_id int, ccf double")
    out = T.cluster_table(Q.assigned(spark, d).join(rows.select("mut_key", "sample_no", "coverage"), "mut_key"), clusters, 4)
    return out.select("mut_key", "sample_no", "coverage", "Cluster_Id", "Cluster_CCF", *[F.round(c, 6).alias(c) for c in ("Probability", "P0", "P1", "P2", "P3")])


def _cluster_sql() -> str:
    from cytoframe.plans.cluster_queries import ASSIGNMENT

    head = ASSIGNMENT[: ASSIGNMENT.index(",\n s as (select")]
    return head + """, v as (select mut_key, cluster_id, w / sum(w) over (partition by mut_key) as p, row_number() over (partition by mut_key order by w desc, cluster_id) as k from w)
 select mut_key, any_value(sample_no) as sample_no, any_value(coverage) as coverage, max(cluster_id) filter (k = 1) as "Cluster_Id", max(peak) filter (k = 1) as "Cluster_CCF", round(max(p) filter (k = 1), 6) as "Probability",
  round(max(p) filter (cluster_id = 0), 6) as "P0", round(max(p) filter (cluster_id = 1), 6) as "P1", round(max(p) filter (cluster_id = 2), 6) as "P2", cast(null as double) as "P3" from v join m using (mut_key) join c using (cluster_id) group by mut_key"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([("rg0", "tumour"), ("rg1", "normal")], "rg string, sm string")
    return T.read_samples(reads(spark, d).drop("sample"), groups, "a.bam").groupBy("sample").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


SAMPLES = with_views("reads") + " select case rg when 'rg0' then 'tumour' when 'rg1' then 'normal' else 'a.bam' end as sample, count(*) as n, cast(sum(pos) as bigint) as pos_sum from reads group by 1"


def sampled(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).withColumn("place", F.col("pos") % 50)
    return T.sampled_bases(rows, ["tid", "place"], TIES[:4], most=7, seed=3).select("tid", "place", *TIES)


SAMPLED = (
    with_views("reads")
    + f" select tid, place, {ID} from (select *, row_number() over (partition by tid, place order by h, {', '.join(TIES[:4])}) as k from (select *, pos % 50 as place, md5('3:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey) as h from reads)) where k <= 7"
)


def variants(spark: SparkSession, d: str) -> DataFrame:
    rows = snps(spark, d).select("tid", "pos", F.substring(F.lit("ACGTN"), (F.col("pos") % 5 + 1).cast("int"), F.lit(1)).alias("ref"), F.substring(F.lit("NACGT"), (F.col("t_a") % 5 + 1).cast("int"), F.lit(1)).alias("consensus"), (F.col("n_a") % 3 - 1).alias("n_indel"))
    return T.variant_sites(rows)


VARIANTS = with_views("snps") + ", x as (select tid, pos, substr('ACGTN', cast(pos % 5 + 1 as int), 1) as ref, substr('NACGT', cast(t_a % 5 + 1 as int), 1) as consensus, n_a % 3 - 1 as n_indel from snps) select * from x where (ref <> 'N' and consensus <> 'N' and ref <> consensus) or n_indel > 0"


def indel_tallies(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).withColumn("cigar", C.parse_cigar(F.col("cigar")))
    return T.indel_tallies(pileup.indel_ahead(rows, ["tid", "flag"]))


INDEL_TALLIES = with_views("reads") + " select tid, pos + 9 as ref_pos, case l_linenumber % 5 when 2 then -2 else 3 end as indel, count(*) as n, count(*) filter ((flag & 16) = 0) as n_forward from reads where l_linenumber % 5 in (2, 3) group by all"


def old_qualities(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[((F.col("l_partkey") + k) % 140).cast("int") for k in range(3)])
    return reads(spark, d).select(*TIES, F.array_join(C.solexa_to_phred(q), ",").alias("quality"))


OLD_QUALITIES = with_views("reads") + f" select {ID}, array_to_string(list_transform([(l_partkey + k) % 140 for k in range(3)], lambda q: cast(least(floor(10 * log10(1 + pow(cast(10 as double), (least(q, 127) - 31) / cast(10 as double))) + 0.499), 93) as int)), ',') as quality from reads"


def segment_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = _counts(spark, d).withColumn("segment", F.floor(F.col("part_no") / 50)).withColumn("ratio", (F.col("n_t") + 1) / (F.col("n_n") + 1).cast("double"))
    out = M.segment_ratios(rows, segment="segment", ratio="ratio", sex="m")
    return out.select("part_no", F.round("copies", 9).alias("copies"), F.round("residual", 9).alias("residual"))


SEGMENT_RATIOS = (
    with_views("reads", "partitions")
    + _COUNTS
    + ", x as (select part_no, tid, (n_t + 1) / cast(n_n + 1 as double) as ratio, part_no // 50 as segment from counts), y as (select *, avg(ratio) over (partition by segment) as mean from x) select part_no, round(mean * 2 * case when tid >= 22 then 0.5 else 1 end, 9) as copies, round(ln(ratio / mean), 9) as residual from y"
)


def name_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each name in natural order, by the key that sorts names of any kind."""
    odd = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("q"), F.col("l_orderkey").cast("string"), F.lit("x10"))).otherwise(F.col("qname"))
    names = reads(spark, d).select(odd.alias("qname")).distinct().withColumn("k", C.natural_key(F.col("qname")))
    return names.select("qname", F.row_number().over(W.orderBy("k")).alias("place"))


NAME_ORDER = with_views("reads") + ", x as (select distinct l_orderkey as n, l_orderkey % 3 = 0 as odd from reads) select 'q' || n || case when odd then 'x10' else '' end as qname, cast(row_number() over (order by n, odd) as int) as place from x"


def merged_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two inputs in the order of the merge, each with its place among those of its chromosome."""
    rows = reads(spark, d).withColumn("pos", F.col("pos") % 1_000)
    both = R.merge_sorted([rows.where("sample = 'T'"), rows.where("sample = 'N'")], ties=TIES).select("tid", "pos", "flag", "source_no", *TIES)
    # rows come out sorted, so numbers rise with place
    return both.withColumn("place", F.row_number().over(W.partitionBy("tid").orderBy(F.monotonically_increasing_id()))).select("tid", "place", *TIES)


MERGED_ORDER = with_views("reads") + f" select tid, cast(row_number() over (partition by tid order by pos % 1000, (flag & 16) <> 0, case sample when 'T' then 0 else 1 end, {ID}) as int) as place, {ID} from reads"


def _near(batch: pa.RecordBatch, read: np.ndarray, query: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases, and a reference that most of them agree with."""
    base, ref = base_arrays(batch, read, query)[0], reference_arrays(batch, read, place)
    own = (place + batch.column("l_partkey").to_numpy()[read]) % 9 == 0
    return base, np.where(own | (query < 0), ref, base)


def mismatch_strings(spark: SparkSession, d: str) -> DataFrame:
    return pileup.read_edits(reads(spark, d), TIES, ["tid"], _near).select(*TIES, "md")


_KEYS = ", ".join(TIES)
MISMATCH_STRINGS = (
    with_views("bases")
    + f""", r as (select *, case when (l_partkey + ref_pos) % 9 = 0 then ref else coalesce(base, ref) end as near from bases where op in ('M', 'D')),
 c as (select {_KEYS}, string_agg(case when op = 'D' then chr(ascii(near) + 32) when base = near then '=' else near end, '' order by ref_pos) as s from r group by {_KEYS}),
 t as (select {_KEYS}, regexp_extract_all(s, '=+|[a-z]+|[A-Z]') as t from c),
 u as (select {_KEYS}, unnest(t) as x, unnest(range(len(t))) as i, len(t) as n from t),
 v as (select *, x[1] = '=' as run, lag(x[1] = '=') over (partition by {_KEYS} order by i) as before from u)
 select {_KEYS}, string_agg(case when run then cast(length(x) as varchar) else case when coalesce(before, false) then '' else '0' end || case when x between 'a' and 'zzzzzzzz' then '^' || upper(x) else x end || case when i = n - 1 then '0' else '' end end, '' order by i) as md from v group by {_KEYS}"""
)

QUERIES = {
    "sk1_read_counts": (read_counts, READ_COUNTS),
    "sk2_snp_table": (snp_rows, SNP_ROWS),
    "sk6_segment_table": (segment_rows, SEGMENT_ROWS),
    "sk11_cluster_table": (cluster_rows, _cluster_sql()),
    "j16_samples": (samples, SAMPLES),
    "o8_sampled": (sampled, SAMPLED),
    "f17_variant_sites": (variants, VARIANTS),
    "a4_indel_tallies": (indel_tallies, INDEL_TALLIES),
    "p7_old_qualities": (old_qualities, OLD_QUALITIES),
    "a11_segment_ratios": (segment_ratios, SEGMENT_RATIOS),
    "p5_name_order": (name_order, NAME_ORDER),
    "o2_merged_order": (merged_order, MERGED_ORDER),
    "v13_mismatch_strings": (mismatch_strings, MISMATCH_STRINGS),
}
