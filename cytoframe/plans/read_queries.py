"""Queries over alignment rows, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.functions import columns as C
from cytoframe.operators import intervals, pileup
from cytoframe.operators import reads as R
from cytoframe.plans.adapters import TIES, bases, compared_arrays, reads, with_views

ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
TARGETS = [(i, f"chr{i + 1}" if i < 22 else "chrX" if i == 22 else "chrY") for i in range(24)]


def view_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.view_filter(reads(spark, d), min_mapq=20, required=1, excluded=1796).select("tid", "pos", "mapq", "flag", *TIES)


VIEW_FILTER = with_views("reads") + f" select tid, pos, mapq, flag, {ID} from reads where mapq >= 20 and (flag & 1) = 1 and (flag & 1796) = 0"


def read_group_filter(spark: SparkSession, d: str) -> DataFrame:
    libraries = spark.createDataFrame([("rg0", "libA"), ("rg1", "libB")], "rg string, lb string")
    rows = reads(spark, d).drop("lb")
    return R.read_group_filter(rows, {"rg0", "rg2"}, "libB", libraries).select("rg", *TIES)


READ_GROUP_FILTER = with_views("reads") + f" select rg, {ID} from reads where rg in ('rg0', 'rg2')"


def library_filter(spark: SparkSession, d: str) -> DataFrame:
    libraries = spark.createDataFrame([("rg0", "libA"), ("rg1", "libB")], "rg string, lb string")
    return R.read_group_filter(reads(spark, d).drop("lb"), None, "libB", libraries).select("rg", *TIES)


LIBRARY_FILTER = with_views("reads") + f" select rg, {ID} from reads where rg = 'rg1'"


def region_scan(spark: SparkSession, d: str) -> DataFrame:
    name, begin, end = R.parse_region("chr5: 10,001-500,000")
    rows = reads(spark, d).withColumn("cigar", C.parse_cigar(F.col("cigar")))
    rows = rows.withColumn("ref_end", F.col("pos") + C.reference_length(F.col("cigar")) - 1)
    tid = next(i for i, n in TARGETS if n == name)
    return R.region_filter(rows, tid, begin, end).select("pos", "ref_end", *TIES)


_REF = "case l_linenumber % 5 when 0 then qlen when 1 then qlen - 5 when 2 then qlen + 2 when 3 then qlen - 3 else qlen + 94 end"
REGION_SCAN = with_views("reads") + f" select pos, pos + {_REF} - 1 as ref_end, {ID} from reads where tid = 4 and pos <= 500000 and pos + {_REF} - 1 > 10000"


def pileup_mask(spark: SparkSession, d: str) -> DataFrame:
    return R.pileup_filter(reads(spark, d)).groupBy("tid", "sample").agg(F.count("*").alias("n"))


PILEUP_MASK = with_views("reads") + " select tid, sample, count(*) as n from reads where (flag & 1796) = 0 group by all"


def multi_pileup_filter(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).where(R.multi_pileup_keep(F.col("flag"), F.col("mapq"), min_mapq=13)).groupBy("tid").agg(F.count("*").alias("n"), F.sum("mapq").alias("mapq_sum"))


MULTI_PILEUP_FILTER = with_views("reads") + " select tid, count(*) as n, cast(sum(mapq) as bigint) as mapq_sum from reads where (flag & 4) = 0 and mapq >= 13 and not ((flag & 1) = 1 and (flag & 2) = 0) group by tid"


def capped_pileup_filter(spark: SparkSession, d: str) -> DataFrame:
    cap = F.col("mapq") - 25
    return reads(spark, d).where(R.multi_pileup_keep(F.col("flag"), F.col("mapq"), min_mapq=13, cap=cap)).groupBy("tid").agg(F.count("*").alias("n"))


CAPPED_PILEUP_FILTER = with_views("reads") + " select tid, count(*) as n from reads where mapq - 25 >= 0 group by tid"


def clipped_mapq(spark: SparkSession, d: str) -> DataFrame:
    cigar = F.when(F.col("l_orderkey") % 9 == 0, F.concat(F.lit("4H"), F.col("cigar"))).otherwise(F.col("cigar"))
    return reads(spark, d).select(*TIES, R.clip_mapq(F.col("mapq"), C.parse_cigar(cigar)).alias("mapq"))


CLIPPED_MAPQ = with_views("reads") + f" select {ID}, case when l_orderkey % 9 = 0 then 0 else mapq end as mapq from reads"


def cigar_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = bases(spark, d, keep=["tid", "pos", "flag", "l_partkey", "l_orderkey"]).withColumn("block", F.floor(F.col("ref_pos") / 10_000).cast("bigint"))
    return rows.groupBy("tid", "block").agg(
        F.count("*").alias("n"), F.count("query_at").alias("n_bases"), F.sum("ref_pos").alias("pos_sum"), F.sum(F.col("query_at").cast("bigint") * (F.col("ref_pos") % 97)).alias("mixed"), F.count_if("is_head").alias("heads"), F.count_if("is_tail").alias("tails")
    )


CIGAR_EXPAND = with_views("bases") + " select tid, cast(floor(ref_pos / 10000) as bigint) as block, count(*) as n, count(query_at) as n_bases, cast(sum(ref_pos) as bigint) as pos_sum, cast(sum(query_at * (ref_pos % 97)) as bigint) as mixed, count(*) filter (is_head) as heads, count(*) filter (is_tail) as tails from bases group by all"


def alignment_end(spark: SparkSession, d: str) -> DataFrame:
    c = C.parse_cigar(F.col("cigar"))
    return reads(spark, d).select(*TIES, (F.col("pos") + C.reference_length(c) - 1).alias("ref_end"), C.query_length(c).cast("bigint").alias("query_length"), C.format_cigar(c).alias("cigar"))


ALIGNMENT_END = with_views("reads") + f" select {ID}, pos + {_REF} - 1 as ref_end, qlen as query_length, cigar from reads"


def ucsc_bins(spark: SparkSession, d: str) -> DataFrame:
    begin = (F.col("pos") - 1).cast("bigint")
    rows = reads(spark, d).select(C.ucsc_bin(begin, begin + F.col("qlen") * 997).cast("bigint").alias("bin"), F.size(C.region_bins(begin, begin + F.col("qlen") * 997)).cast("bigint").alias("n_bins"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("n_bins").alias("n_bins"))


_LEVEL = lambda s, o, other: f"case when (b >> {s}) = (e >> {s}) then {o} + (b >> {s}) else {other} end"
UCSC_BINS = (
    with_views("reads")
    + ", x as (select pos - 1 as b, pos - 1 + qlen * 997 - 1 as e from reads) select cast("
    + _LEVEL(14, 4681, _LEVEL(17, 585, _LEVEL(20, 73, _LEVEL(23, 9, _LEVEL(26, 1, "0")))))
    + " as bigint) as bin, count(*) as n, cast(sum(1 + "
    + " + ".join(f"((e >> {s}) - (b >> {s}) + 1)" for s in (26, 23, 20, 17, 14))
    + ") as bigint) as n_bins from x group by 1"
)


def natural_order(spark: SparkSession, d: str) -> DataFrame:
    names = reads(spark, d).select("qname").distinct().withColumn("k", C.natural_key(F.col("qname")))
    return names.select("qname", F.substring("k", 2, 20).cast("bigint").alias("number"), F.length("k").cast("bigint").alias("size"))


NATURAL_ORDER = with_views("reads") + " select qname, cast(substr(qname, 2) as bigint) as number, cast(21 as bigint) as size from reads group by qname"


def flag_text(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).groupBy("flag").agg(F.count("*").alias("n"))
    letters = C.flag_letters(F.col("flag"))
    return rows.select("flag", "n", letters.alias("letters"), C.parse_flag(letters).alias("again"), C.parse_flag(F.concat(F.lit("0x"), F.lower(F.hex("flag")))).alias("from_hex"))


FLAG_TEXT = with_views("reads") + " select flag, count(*) as n, " + " || ".join(f"case when (flag & {1 << i}) <> 0 then '{c}' else '' end" for i, c in enumerate(C.FLAG_LETTERS)) + " as letters, flag as again, flag as from_hex from reads group by flag"


def chromosome_names(spark: SparkSession, d: str) -> DataFrame:
    names = F.when(F.col("tid") < 22, F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string"))).when(F.col("tid") == 22, "chrX").otherwise("Y")
    rows = reads(spark, d).groupBy("tid").agg(F.count("*").alias("n"))
    return rows.select("tid", "n", names.alias("name"), C.chromosome_index(names).alias("found"), C.sex_factor(F.col("tid"), F.lit("m")).alias("factor"))


CHROMOSOME_NAMES = with_views("reads") + " select tid, count(*) as n, case when tid < 22 then 'chr' || (tid + 1) when tid = 22 then 'chrX' else 'Y' end as name, tid as found, cast(case when tid >= 22 then 0.5 else 1 end as double) as factor from reads group by tid"


def flag_statistics(spark: SparkSession, d: str) -> DataFrame:
    return R.flag_statistics(reads(spark, d))


FLAG_STATISTICS = (
    with_views("reads")
    + """ select count(*) as n_reads, count(*) filter ((flag & 512) <> 0) as n_qcfail, count(*) filter ((flag & 1024) <> 0) as n_dup,
 count(*) filter ((flag & 4) = 0) as n_mapped, count(*) filter ((flag & 1) = 1) as n_paired, count(*) filter ((flag & 3) = 3) as n_proper,
 count(*) filter ((flag & 65) = 65) as n_read1, count(*) filter ((flag & 129) = 129) as n_read2, count(*) filter ((flag & 13) = 9) as n_single,
 count(*) filter ((flag & 13) = 1) as n_both_mapped, count(*) filter ((flag & 13) = 1 and mtid <> tid) as n_diff_chr,
 count(*) filter ((flag & 13) = 1 and mtid <> tid and mapq >= 5) as n_diff_high from reads"""
)


def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame(TARGETS, "tid int, name string")
    rows = reads(spark, d).withColumn("tid", F.when((F.col("l_orderkey") % 41 == 0), -1).otherwise(F.col("tid")).cast("int"))
    return R.index_statistics(rows, targets)


INDEX_STATISTICS = with_views("reads") + ", t as (select cast(unnest(range(-1, 24)) as int) as tid), r as (select case when l_orderkey % 41 = 0 then -1 else tid end as tid, flag from reads) select t.tid, count(r.tid) filter ((flag & 4) = 0) as n_mapped, count(r.tid) filter ((flag & 4) <> 0) as n_unmapped from t left join r on t.tid = r.tid group by t.tid"


def count_only(spark: SparkSession, d: str) -> DataFrame:
    return R.view_filter(reads(spark, d), min_mapq=30).agg(F.count("*").alias("n"))


COUNT_ONLY = with_views("reads") + " select count(*) as n from reads where mapq >= 30"


def tag_view(spark: SparkSession, d: str) -> DataFrame:
    tags = F.create_map(F.lit("RG"), F.col("rg"), F.lit("LB"), F.col("lb"))
    return reads(spark, d).select("qname", "flag", tags.alias("aux"), *TIES).select("qname", "flag", F.element_at("aux", "RG").alias("value"), *TIES).where("value is not null")


TAG_VIEW = with_views("reads") + f" select qname, flag, rg as value, {ID} from reads where rg is not null"


def valid_reads(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).withColumn("tid", F.col("tid") + F.when(F.col("l_orderkey") % 13 == 0, 10).when(F.col("l_orderkey") % 17 == 0, -12).otherwise(0))
    rows = rows.withColumn("mtid", F.when(F.col("l_partkey") % 11 == 0, -2).otherwise(F.col("mtid"))).withColumn("qname", F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.col("qname")))
    return R.valid_reads(rows, 24).groupBy("tid").agg(F.count("*").alias("n"))


VALID_READS = with_views("reads") + " select tid, count(*) as n from (select tid + case when l_orderkey % 13 = 0 then 10 when l_orderkey % 17 = 0 then -12 else 0 end as tid from reads where l_partkey % 11 <> 0 and l_suppkey % 9 <> 0) x where tid between -1 and 23 group by tid"


def sorted_order(spark: SparkSession, d: str) -> DataFrame:
    return intervals.number_rows(reads(spark, d), group="tid", at="pos", order=TIES).select("ord", "tid", "pos", *TIES)


SORTED_ORDER = with_views("reads") + f" select row_number() over (order by tid, pos, {ID}) - 1 as ord, tid, pos, {ID} from reads"


def merged_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).drop("rg")
    both = R.merge_sorted([rows.where("sample = 'T'"), rows.where("sample = 'N'")], names=["t", "n"], ties=TIES)
    return both.groupBy("tid", "rg", "source_no").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


MERGED_INPUTS = with_views("reads") + " select tid, lower(sample) as rg, case sample when 'T' then 0 else 1 end as source_no, count(*) as n, min(pos) as first, max(pos) as last from reads group by all"


def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).withColumn("pos", (F.col("pos") % 500).cast("bigint")).withColumn("isize", F.col("isize") % 50)
    return R.remove_duplicate_pairs(rows, quality="qsum", order=TIES).select("tid", "pos", "isize", "qname", *TIES)


DUPLICATE_PAIRS = (
    with_views("reads")
    + f""", x as (select * replace (pos % 500 as pos, isize % 50 as isize), (flag & 1) = 1 and (flag & 12) = 0 and mtid = tid as same from reads),
 heads as (select *, row_number() over (partition by lb, tid, pos, isize order by qsum desc, {ID}) as k from x where same and isize > 0),
 losers as (select distinct tid, qname from heads where k > 1)
 select tid, pos, isize, qname, {ID} from heads where k = 1
 union all select tid, pos, isize, qname, {ID} from x where not (same and isize > 0) and (not same or not exists (select 1 from losers l where l.tid = x.tid and l.qname = x.qname))"""
)


def duplicate_singles(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).withColumn("pos", (F.col("pos") % 300).cast("bigint")).withColumn("ref_end", F.col("pos") + F.col("qlen") - 1)
    return R.remove_duplicate_singles(rows, quality="qsum", order=TIES).select("tid", "pos", "qname", *TIES)


DUPLICATE_SINGLES = (
    with_views("reads")
    + f""", x as (select * replace (pos % 300 as pos), pos % 300 + qlen - 1 as ref_end from reads)
 select tid, pos, qname, {ID} from (select *, row_number() over (partition by lb, tid, (flag & 16), case when (flag & 16) <> 0 then ref_end else pos end order by qsum desc, {ID}) as k from x where (flag & 5) = 0) where k = 1
 union all select tid, pos, qname, {ID} from x where (flag & 5) <> 0"""
)


def forced_singles(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).withColumn("pos", (F.col("pos") % 300).cast("bigint")).withColumn("ref_end", F.col("pos") + F.col("qlen") - 1)
    return R.remove_duplicate_singles(rows, quality="qsum", order=TIES, forced=True).select("tid", "pos", "qname", *TIES)


FORCED_SINGLES = DUPLICATE_SINGLES.replace("(flag & 5)", "(flag & 4)")


def fixed_mates(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).withColumn("ref_end", F.col("pos") + F.col("qlen") - 1).withColumn("mpos", F.lit(0).cast("bigint"))
    return R.fix_mates(rows, order=TIES[1:]).select("qname", "flag", "mtid", "mpos", "isize", *TIES)


FIXED_MATES = (
    with_views("reads")
    + f""", n as (select *, case when (flag & 16) <> 0 then pos + qlen - 1 else pos - 1 end as five, row_number() over w as k,
   lead(struct_pack(tid := tid, pos := pos, flag := flag, five := case when (flag & 16) <> 0 then pos + qlen - 1 else pos - 1 end)) over w as after,
   lag(struct_pack(tid := tid, pos := pos, flag := flag, five := case when (flag & 16) <> 0 then pos + qlen - 1 else pos - 1 end)) over w as before
   from reads window w as (partition by qname order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
 m as (select *, case when k % 2 = 1 then after else before end as mate, l_orderkey = (select max(l_orderkey) from reads) as final from n)
 select qname, cast(case when mate is null and final then flag when mate is null then case when (flag & 1) = 1 then (flag | 8) & ~34 else flag end
   else ((flag & ~32) | case when (mate.flag & 16) <> 0 then 32 else 0 end | case when (mate.flag & 4) <> 0 then 8 else 0 end) & case when (mate.flag & 4) <> 0 then ~2 else ~0 end end as int) as flag,
  case when mate is null and final then mtid else coalesce(mate.tid, -1) end as mtid, coalesce(mate.pos, 0) as mpos,
  case when mate is null and final then isize when mate is not null and tid = mate.tid and (flag & 12) = 0 and (mate.flag & 12) = 0 then mate.five - five else 0 end as isize, {ID} from m"""
)


def allele_counts(spark: SparkSession, d: str) -> DataFrame:
    # what a read decides is decided before it is taken apart
    good = reads(spark, d).where("mapq > 0 and (flag & 1024) = 0").withColumn("least", pileup.least_quality(F.col("mapq"))).where("least is not null")
    sure = bases(spark, d, source=good, ops="MS", keep=["tid", "pos", "flag", "least", "l_partkey", "l_orderkey"], ends=False).where("quality >= least")
    return pileup.allele_counts(sure, ["tid", "ref_pos"], strand="reverse")


_SURE = "quality >= 10 and mapq > 0 and (flag & 1024) = 0 and (1 - pow(cast(10 as double), -mapq / cast(10 as double))) * (1 - pow(cast(10 as double), -quality / cast(10 as double))) >= 0.99"
ALLELE_COUNTS = with_views("bases") + " select tid, ref_pos, " + ", ".join(f"count(*) filter (base = '{b}') as n_{b.lower()}, count(*) filter (base = '{b}' and reverse) as r_{b.lower()}" for b in "ACGT") + f" from bases where query_at is not null and base is not null and {_SURE} group by all"


def snp_counts(spark: SparkSession, d: str) -> DataFrame:
    from cytoframe.plans.adapters import snps

    good = reads(spark, d).where("mapq > 0 and (flag & 1024) = 0").withColumn("least", pileup.least_quality(F.col("mapq"))).where("least is not null")
    near = bases(spark, d, source=good, ops="MS", keep=["tid", "pos", "flag", "sample", "least", "l_partkey", "l_orderkey"], ends=False).where("quality >= least").withColumn("ref_pos", F.col("ref_pos") % 5_000)
    per = {s: pileup.allele_counts(near.where(F.col("sample") == s), ["tid", "ref_pos"]).withColumnRenamed("ref_pos", "pos") for s in "TN"}
    sites = snps(spark, d).select("tid", (F.col("pos") % 5_000).alias("pos")).distinct()
    return pileup.snp_rows(per["T"], per["N"], sites)


SNP_COUNTS = (
    with_views("bases", "snps")
    + ", c as (select tid, ref_pos % 5000 as pos, "
    + ", ".join(f"count(*) filter (base = '{b}' and sample = '{s}') as {s.lower()}_{b.lower()}" for s in "TN" for b in "ACGT")
    + f" from bases where query_at is not null and {_SURE} group by all), s as (select distinct tid, pos % 5000 as pos from snps) select c.* from c join s using (tid, pos) where t_a + t_c + t_g + t_t >= 5 and n_a + n_c + n_g + n_t >= 5"
)


def pileup_text(spark: SparkSession, d: str) -> DataFrame:
    return pileup.read_pileups(reads(spark, d).where("(flag & 1796) = 0"), ["l_partkey", "l_orderkey"], TIES, compared_arrays)


_LETTER = lambda x: f"substr('ACGT', cast(({x}) % 4 + 1 as int), 1)"
_GAINED = " || ".join(_LETTER(f"l_partkey + (query_at + {k}) * 7 + l_orderkey") for k in (1, 2, 3))
_LOST = " || ".join(_LETTER(f"(ref_pos + {k}) * 7 + tid") for k in (1, 2))
PILEUP_TEXT = (
    with_views("bases")
    + f""", cells as (select tid, ref_pos, pos, {ID}, case when is_head then '^' || chr(case when mapq > 93 then 126 else mapq + 33 end) else '' end
   || case when op = 'N' then case when reverse then '<' else '>' end when query_at is null then '*' when base = ref then case when reverse then ',' else '.' end when reverse then lower(base) else base end
   || case when pattern = 3 and r0 + k = 9 then '+3' || case when reverse then lower({_GAINED}) else {_GAINED} end when pattern = 2 and r0 + k = 9 then '-2' || case when reverse then lower({_LOST}) else {_LOST} end else '' end
   || case when is_tail then '$' else '' end as cell from bases where (flag & 1796) = 0)
 select tid, ref_pos as pos, count(*) as depth, string_agg(cell, '' order by pos, {ID}) as pileup from cells group by tid, ref_pos"""
)


def mapping_rms(spark: SparkSession, d: str) -> DataFrame:
    rows = bases(spark, d).withColumn("block", (F.col("ref_pos") % 1_000))
    return pileup.rms_mapq(rows, ["tid", "block"]).join(pileup.iupac_consensus(rows.where("base is not null"), ["tid", "block"]), ["tid", "block"], "left")


MAPPING_RMS = (
    with_views("bases")
    + """, m as (select tid, ref_pos % 1000 as block, cast(trunc(sqrt(avg(mapq * mapq)) + 0.499) as int) as rms_mapq from bases group by all),
 c as (select tid, ref_pos % 1000 as block, bit_or(case base when 'A' then 1 when 'C' then 2 when 'G' then 4 else 8 end) as code from bases where query_at is not null group by all)
 select tid, block, rms_mapq, substr('=ACMGRSVTWYHKDBN', code + 1, 1) as consensus from m left join c using (tid, block)"""
)


def sample_depth(spark: SparkSession, d: str) -> DataFrame:
    return pileup.read_depths(reads(spark, d), ["T", "N"])


SAMPLE_DEPTH = with_views("bases") + " select tid, ref_pos as pos, count(*) filter (sample = 'T') as depth_T, count(*) filter (sample = 'N') as depth_N from bases where query_at is not null group by all"


def call_annotations(spark: SparkSession, d: str) -> DataFrame:
    rows = bases(spark, d).where("base is not null").withColumn("end_distance", F.least(F.col("query_at").cast("bigint"), F.col("qlen") - 1 - F.col("query_at")))
    rows = rows.withColumn("block", F.col("ref_pos") % 2_000)
    out = pileup.call_annotations(rows, ["tid", "block", "sample"])
    return out.select(*[F.col(c).cast("bigint").alias(c) if c not in ("sample", "tid") else F.col(c) for c in out.columns])


def _annotations_sql() -> str:
    out = ["count(*) as depth"] + [f"cast(sum(case when base = '{b}' then q else 0 end) as bigint) as qsum_{b.lower()}" for b in "ACGT"]
    for name, test in (("ref", "base = ref"), ("alt", "base <> ref")):
        out += [f"count(*) filter ({test} and not reverse) as {name}_forward", f"count(*) filter ({test} and reverse) as {name}_reverse"]
        for c in ("quality", "mapq", "far"):
            out += [f"cast(sum(case when {test} then {c} else 0 end) as bigint) as {name}_{c}", f"cast(sum(case when {test} then {c} * {c} else 0 end) as bigint) as {name}_{c}_squared"]
    return with_views("bases") + f", u as (select *, ref_pos % 2000 as block, least(quality, mapq, 60) as q, least(query_at, qlen - 1 - query_at, 25) as far from bases where query_at is not null and quality >= 13) select tid, block, sample, {', '.join(out)} from u where q >= 4 group by tid, block, sample"


CALL_ANNOTATIONS = _annotations_sql()


def indel_sites(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).withColumn("cigar", C.parse_cigar(F.col("cigar")))
    return pileup.indel_ahead(rows, ["tid"]).groupBy("tid", "ref_pos", "indel").agg(F.count("*").alias("n"))


INDEL_SITES = with_views("reads") + " select tid, pos + 9 as ref_pos, case l_linenumber % 5 when 2 then -2 else 3 end as indel, count(*) as n from reads where l_linenumber % 5 in (2, 3) group by all"


def capped_depth(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).withColumn("pos", F.col("pos") % 200)
    return pileup.cap_depth(rows, order=TIES, most=5).groupBy("tid", "pos").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("part_sum"))


CAPPED_DEPTH = with_views("reads") + f" select tid, pos, count(*) as n, cast(sum(l_partkey) as bigint) as part_sum from (select *, row_number() over (partition by tid, pos order by {ID}) as k from (select * replace (pos % 200 as pos) from reads)) where k <= 5 group by all"

def layers(spark: SparkSession, d: str) -> DataFrame:
    from cytoframe.operators.layers import read_layers

    rows = reads(spark, d).where("(flag & 1796) = 0").withColumn("ref_end", F.col("pos") + C.reference_length(C.parse_cigar(F.col("cigar"))) - 1)
    return read_layers(rows, order=TIES).select("tid", "pos", "ref_end", "layer", *TIES)


QUERIES = {
    "w10_layers": (layers, None),
    "f1_view_filter": (view_filter, VIEW_FILTER),
    "f2_read_group_filter": (read_group_filter, None),
    "f3_library_filter": (library_filter, LIBRARY_FILTER),
    "f4_region_scan": (region_scan, REGION_SCAN),
    "f5_pileup_mask": (pileup_mask, PILEUP_MASK),
    "f6_multi_pileup_filter": (multi_pileup_filter, MULTI_PILEUP_FILTER),
    "f7_capped_pileup_filter": (capped_pileup_filter, CAPPED_PILEUP_FILTER),
    "f9_clipped_mapq": (clipped_mapq, CLIPPED_MAPQ),
    "p1_cigar_expand": (cigar_expand, CIGAR_EXPAND),
    "p2_alignment_end": (alignment_end, ALIGNMENT_END),
    "p4_ucsc_bins": (ucsc_bins, UCSC_BINS),
    "p5_natural_order": (natural_order, NATURAL_ORDER),
    "p8_tag_view": (tag_view, TAG_VIEW),
    "p9_valid_reads": (valid_reads, VALID_READS),
    "x8_chromosome_names": (chromosome_names, CHROMOSOME_NAMES),
    "x11_flag_text": (flag_text, FLAG_TEXT),
    "a23_flag_statistics": (flag_statistics, FLAG_STATISTICS),
    "a24_index_statistics": (index_statistics, INDEX_STATISTICS),
    "a25_count_only": (count_only, COUNT_ONLY),
    "o1_sorted_order": (sorted_order, SORTED_ORDER),
    "o2_merged_inputs": (merged_inputs, MERGED_INPUTS),
    "v14_duplicate_pairs": (duplicate_pairs, DUPLICATE_PAIRS),
    "v15_duplicate_singles": (duplicate_singles, DUPLICATE_SINGLES),
    "v15_forced_singles": (forced_singles, FORCED_SINGLES),
    "v16_fixed_mates": (fixed_mates, FIXED_MATES),
    "a3_allele_counts": (allele_counts, ALLELE_COUNTS),
    "f11_snp_counts": (snp_counts, SNP_COUNTS),
    "a26_pileup_text": (pileup_text, PILEUP_TEXT),
    "a27_mapping_rms": (mapping_rms, MAPPING_RMS),
    "j15_sample_depth": (sample_depth, SAMPLE_DEPTH),
    "a29_call_annotations": (call_annotations, CALL_ANNOTATIONS),
    "w11_indel_sites": (indel_sites, INDEL_SITES),
    "w12_capped_depth": (capped_depth, CAPPED_DEPTH),
}
# reads without a group come to the library test, whose library isn't known
QUERIES["f2_read_group_filter"] = (read_group_filter, READ_GROUP_FILTER)
