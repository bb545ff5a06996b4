"""Queries of alleles, likelihoods and tags, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions import columns as C
from cytoframe.functions.arrays import ranges
from cytoframe.operators import calling as V
from cytoframe.operators import intervals, pileup
from cytoframe.plans.adapters import LOOKED_AT, TIES, base_arrays, bases, letter, mutations, partitions, reads, snps, with_views
from cytoframe.session import written


def ranked_alleles(spark: SparkSession, d: str) -> DataFrame:
    rows = snps(spark, d).withColumn("ref", F.substring(F.lit("ACGTN"), (F.col("pos") % 5 + 1).cast("int"), F.lit(1)))
    rows = rows.select("tid", "pos", "ref", F.col("t_a").alias("qsum_a"), (F.col("t_b") % 7).alias("qsum_c"), (F.col("n_a") % 5).alias("qsum_g"), (F.col("n_b") % 3).alias("qsum_t"))
    return V.ranked_alleles(rows, by=["tid", "pos"]).select("tid", "pos", "alleles", "unseen")


RANKED_ALLELES = (
    with_views("snps")
    + """, x as (select tid, pos, substr('ACGTN', cast(pos % 5 + 1 as int), 1) as ref, t_a as a, t_b % 7 as c, n_a % 5 as g, n_b % 3 as t from snps),
 y as (select tid, pos, ref, unnest(['A', 'C', 'G', 'T', 'N']) as b, unnest([a, c, g, t, 0]) as q from x),
 o as (select *, row_number() over (partition by tid, pos, q = 0 order by b desc) as k from y where b <> ref and b <> 'N')
 select x.tid, x.pos, ref || coalesce(string_agg(b, '' order by q desc, b desc) filter (q > 0 or k = 1), '') as alleles,
  cast(case when count(*) filter (q = 0) > 0 then count(*) filter (q > 0) + 1 else -1 end as int) as unseen from x join o using (tid, pos, ref) group by x.tid, x.pos, ref"""
)


def likelihoods(spark: SparkSession, d: str) -> DataFrame:
    pl = V.shifted(V.count_likelihoods(F.col("t_a") % 11, F.col("t_b") % 11, F.lit(20)))
    return snps(spark, d).select("tid", "pos", F.array_join(pl, ",").alias("pl"), V.genotype_quality(pl).alias("quality"))


_HOMO = "cast(round(-10 * ({0} * log10(cast(0.99 as double)) + {1} * log10(cast(0.01 as double) / 3))) as int)"
LIKELIHOODS = (
    with_views("snps")
    + f", x as (select tid, pos, {_HOMO.format('(t_a % 11)', '(t_b % 11)')} as a, cast(round(-10 * (t_a % 11 + t_b % 11) * log10(cast(0.5 as double))) as int) as b, {_HOMO.format('(t_b % 11)', '(t_a % 11)')} as c from snps), y as (select *, least(a, b, c) as m from x), z as (select tid, pos, [least(a - m, 255), least(b - m, 255), least(c - m, 255)] as pl from y) select tid, pos, array_to_string(pl, ',') as pl, least(list_sort(pl)[2] - list_sort(pl)[1], 99) as quality from z"
)


def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    return V.best_candidates(reads(spark, d).withColumn("block", F.floor(F.col("pos") / 1000).cast("bigint")), ["tid", "block"], score="qsum", order=TIES).select("tid", "block", "qsum", *TIES)


BEST_CANDIDATES = with_views("reads") + " select tid, block, qsum, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (select *, pos // 1000 as block, row_number() over (partition by tid, pos // 1000 order by qsum desc, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from reads) where k <= 2"


def majority(spark: SparkSession, d: str) -> DataFrame:
    return V.majority(reads(spark, d).withColumn("block", F.floor(F.col("pos") / 1000).cast("bigint")), ["tid", "block"], value="mapq")


MAJORITY = with_views("reads") + " select tid, block, mapq, n from (select tid, pos // 1000 as block, mapq, count(*) as n, row_number() over (partition by tid, pos // 1000 order by count(*) desc, mapq) as k from reads group by tid, pos // 1000, mapq) where k = 1"


def site_list(spark: SparkSession, d: str) -> DataFrame:
    sites = mutations(spark, d).select("tid", (F.col("pos") % 2_000).alias("pos"))
    rows = reads(spark, d).withColumn("pos", F.col("pos") % 2_000)
    return pileup.restrict_sites(rows, sites).select("tid", "pos", *TIES)


SITE_LIST = with_views("reads", "mutations") + " select r.tid, r.pos % 2000 as pos, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from reads r where exists (select 1 from mutations m where m.tid = r.tid and m.pos % 2000 = r.pos % 2000)"


def strand_bias(spark: SparkSession, d: str) -> DataFrame:
    rows = snps(spark, d).select(*[(F.col(c) % 6).cast("int").alias(c) for c in ("t_a", "t_b", "n_a", "n_b")]).distinct()
    return rows.select("t_a", "t_b", "n_a", "n_b", F.round(V.strand_bias(F.col("t_a"), F.col("t_b"), F.col("n_a"), F.col("n_b")), 5).alias("bias"))


STRAND_BIAS = (
    with_views("snps")
    + """, x as (select distinct cast(t_a % 6 as int) as t_a, cast(t_b % 6 as int) as t_b, cast(n_a % 6 as int) as n_a, cast(n_b % 6 as int) as n_b from snps),
 y as (select *, unnest(range(greatest(0, t_a - n_b), least(t_a + t_b, t_a + n_a) + 1)) as k from x),
 z as (select *, lgamma(t_a + t_b + 1) + lgamma(n_a + n_b + 1) + lgamma(t_a + n_a + 1) + lgamma(t_b + n_b + 1) - lgamma(t_a + t_b + n_a + n_b + 1) as f from y),
 p as (select *, f - lgamma(k + 1) - lgamma(t_a + t_b - k + 1) - lgamma(t_a + n_a - k + 1) - lgamma(n_b - t_a + k + 1) as lp, f - lgamma(t_a + 1) - lgamma(t_b + 1) - lgamma(n_a + 1) - lgamma(n_b + 1) as l0 from z)
 select t_a, t_b, n_a, n_b, round(least(-10 * log10(least(sum(case when lp <= l0 + 1e-7 then exp(lp) else 0 end), 1)), 255), 5) as bias from p group by t_a, t_b, n_a, n_b"""
)


def colours(spark: SparkSession, d: str) -> DataFrame:
    letter = lambda x: F.substring(F.lit("ACGTN"), (x % 5 + 1).cast("int"), F.lit(1))
    return reads(spark, d).select(letter(F.col("l_partkey")).alias("x"), letter(F.col("l_suppkey")).alias("y")).distinct().select("x", "y", V.colour(F.col("x"), F.col("y")).cast("bigint").alias("colour"), C.base_index(F.col("x")).cast("bigint").alias("index"), C.base_code(F.col("x")).alias("code"))


COLOURS = with_views("reads") + " select x, y, case when x = 'N' or y = 'N' then 4 else xor(strpos('ACGT', x) - 1, strpos('ACGT', y) - 1) end as colour, case when x = 'N' then 4 else strpos('ACGT', x) - 1 end as \"index\", case x when 'A' then 1 when 'C' then 2 when 'G' then 4 when 'T' then 8 else 15 end as code from (select distinct substr('ACGTN', cast(l_partkey % 5 + 1 as int), 1) as x, substr('ACGTN', cast(l_suppkey % 5 + 1 as int), 1) as y from reads)"


def tags(spark: SparkSession, d: str) -> DataFrame:
    aux = F.create_map(F.lit("LB"), F.col("lb"), F.lit("NM"), (F.col("mapq") % 5).cast("string"))
    out = V.set_tag(V.set_tag(aux, "RG", F.col("rg")), "NM", F.when(F.col("mapq") % 2 == 0, "0"))
    return reads(spark, d).select(out.alias("m")).groupBy(F.element_at("m", "RG").alias("rg"), F.try_element_at("m", F.lit("NM")).alias("nm")).agg(F.count("*").alias("n"), F.sum(F.size("m")).alias("tags"))


TAGS = with_views("reads") + " select rg, case when mapq % 2 = 0 then '0' end as nm, count(*) as n, cast(sum(1 + case when rg is null then 0 else 1 end + case when mapq % 2 = 0 then 1 else 0 end) as bigint) as tags from reads group by all"


def neighbour_sites(spark: SparkSession, d: str) -> DataFrame:
    """Breakpoints in the first partition that holds them."""
    points = mutations(spark, d).select("mut_key", "tid", "pos")
    return intervals.first_match(points, partitions(spark).select("tid", "part_no", "p_start", "p_end"), key=["mut_key"], group="tid", at="pos", begin="p_start", end="p_end", ordinal="part_no", width=1_000)


NEIGHBOUR_SITES = with_views("mutations") + " select mut_key, tid * 1000 + (pos - 1) // 1000 as part_no from mutations"

def edit_distances(spark: SparkSession, d: str) -> DataFrame:
    inserted = reads(spark, d).withColumn("n", F.when(F.col("l_linenumber") % 5 == 3, 3).otherwise(0)).select(*TIES, "n").distinct()
    return pileup.edit_distances(bases(spark, d), TIES, inserted).groupBy("nm").agg(F.count("*").alias("n"))


EDIT_DISTANCES = with_views("bases") + " select nm, count(*) as n from (select count(*) filter (op = 'D' or base <> ref) + max(case when pattern = 3 then 3 else 0 end) as nm from bases where op in ('M', 'D') group by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) group by nm"


def theta_inverse(spark: SparkSession, d: str) -> DataFrame:
    """The imbalance that noise of two sizes turns into what is seen."""
    rows = snps(spark, d).select("tid", "pos", ((F.col("t_a") + F.col("t_b")) / 100.0).alias("theta"), (0.02 + F.col("n_a") % 2 / 20.0).alias("sigma"))
    return rows.select("tid", "pos", F.round(C.theta_inverse(F.col("theta"), F.col("sigma")), 6).alias("bare"))


_HALF = "((low + high) / 2)"
THETA_INVERSE = (
    with_views("snps").replace("with ", "with recursive ", 1)
    + f""", x as (select tid, pos, (t_a + t_b) / cast(100 as double) as y, cast(0.02 as double) + n_a % 2 / cast(20 as double) as s from snps),
 d as (select distinct y, s from x),
 inv as (select y, s, cast(0 as double) as low, cast(1 as double) as high, 0 as n from d
  union all select y, s, case when below then {_HALF} else low end, case when below then high else {_HALF} end, n + 1 from (select *, {C.theta_corr_sql(_HALF, "s")} < y as below from inv where n < 40)),
 out as (select y, s, case when y <= {C.theta_corr_sql("cast(0 as double)", "s")} then 0 else {_HALF} end as bare from inv where n = 40)
 select tid, pos, round(bare, 6) as bare from x join out using (y, s)"""
)

#: Places that sites are folded to, so that they are deep enough.
FOLDED = 5_000


def _sites(spark: SparkSession, d: str) -> DataFrame:
    columns = {c: F.col(c) for c in ("flag", *LOOKED_AT)}
    return V.read_base_sums(reads(spark, d).where("(flag & 1796) = 0"), columns, base_arrays, keys=TIES, fold=FOLDED)


def genotypes(spark: SparkSession, d: str) -> DataFrame:
    rows = V.genotype_likelihoods(_sites(spark, d))
    return rows.select("tid", "place", "n", *[F.round(F.get("likelihoods", F.lit(k)), 4).alias("p_" + "".join("acgt"[x] for x in g)) for k, g in enumerate(V.GENOTYPES)])


def _genotypes_sql() -> str:
    terms = "list_sum(list_transform(range({0}, n + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(e) + (n - x) * ln(1 - e))))"
    number = lambda b: f"n_{b}"
    parts = []
    for i, j in V.GENOTYPES:
        others = " + ".join(f"cost_{b}" for k, b in enumerate("acgt") if k not in (i, j)) or "0"
        x, y = number("acgt"[i]), number("acgt"[j])
        parts.append(others if i == j else f"greatest({others} - cast(4.343 as double) * (lgamma({x} + {y} + 1) - lgamma({x} + 1) - lgamma({y} + 1) - ({x} + {y}) * ln(cast(2 as double))), 0)")
    return (
        with_views("bases")
        + f""", b as (select tid, ref_pos % {FOLDED} as place, base, reverse, least(greatest(quality, 4), 63) as q, count(*) over (partition by tid, ref_pos % {FOLDED}) as depth, {", ".join(TIES)}, query_at
   from bases where query_at is not null and (flag & 1796) = 0),
 b0 as (select * from b where depth <= 255 union all select * exclude (d) from (select *, row_number() over (partition by tid, place order by md5('0:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_extendedprice || ':' || query_at), {", ".join(TIES)}, query_at) as d from b where depth > 255) where d <= 255),
 b1 as (select *, row_number() over (partition by tid, place order by q desc, reverse desc, base desc) as r from b0),
 b2 as (select *, count(*) over (partition by tid, place) as n, row_number() over (partition by tid, place, base order by r) - 1 as k, row_number() over (partition by tid, place, base, reverse order by r) - 1 as w from b1 where r <= 255),
 t as (select q, n, k, -10 * log10({terms.format("k + 1")} / {terms.format("k")}) as beta from (select distinct q, n, k, pow(cast(10 as double), -q / cast(10 as double)) as e from b2)),
 s as (select tid, place, count(*) as n, """
        + ", ".join(f"count(*) filter (base = '{b}') as n_{b.lower()}, sum(case when base = '{b}' then (pow(cast(0.83 as double), w) * cast(0.97 as double) + cast(0.03 as double)) * beta else 0 end) as cost_{b.lower()}" for b in "ACGT")
        + " from b2 join t using (q, n, k) group by tid, place), g as (select tid, place, n, "
        + ", ".join(f"{x} as p_{'acgt'[i]}{'acgt'[j]}" for x, (i, j) in zip(parts, V.GENOTYPES))
        + " from s)"
    )


_PLS = [f"p_{'acgt'[i]}{'acgt'[j]}" for i, j in V.GENOTYPES]
GENOTYPES = _genotypes_sql() + " select tid, place, n, " + ", ".join(f"round({p}, 4) as {p}" for p in _PLS) + " from g"


#: Moves exact decimals off the halves that engines round differently.
def _older(spark: SparkSession, d: str, dependent: bool) -> DataFrame:
    columns = {c: F.col(c) for c in ("flag", *LOOKED_AT)} | {"cap": F.col("mapq")}
    out = V.older_read_likelihoods(reads(spark, d).where("(flag & 1796) = 0 and mapq > 0"), columns, base_arrays, least=13, fold=FOLDED, dependent=dependent)
    return out.select("tid", "place", "n", *[F.round(F.get("likelihoods", F.lit(k)) + 1.2345678e-7, 4).alias("p_" + "".join("acgt"[x] for x in g)) for k, g in enumerate(V.GENOTYPES)])


def dependent_model(spark: SparkSession, d: str) -> DataFrame:
    return _older(spark, d, True)


def plain_model(spark: SparkSession, d: str) -> DataFrame:
    return _older(spark, d, False)


def _plain_model_sql() -> str:
    cost = lambda i, j: " + ".join(f"e_{b}" for k, b in enumerate("acgt") if k not in (i, j)) + ("" if i == j else f" - cast(4.343 as double) * (n_{'acgt'[i]} + n_{'acgt'[j]}) * ln(cast(0.5 as double))")
    return (
        with_views("bases")
        + f""", b0 as (select tid, ref_pos % {FOLDED} as place, base, reverse, greatest(least(quality, mapq), 4) as q from bases where query_at is not null and (flag & 1796) = 0 and mapq > 0 and quality >= 13),
 b1 as (select *, row_number() over (partition by tid, place, base, reverse order by q desc) - 1 as w from b0),
 s as (select tid, place, count(*) as n, """
        + ", ".join(f"count(*) filter (base = '{b}') as c_{b.lower()}, coalesce(sum((pow(cast(0.83 as double), least(w, 255)) * cast(0.97 as double) + cast(0.03 as double)) * q) filter (base = '{b}'), 0) as e_{b.lower()}" for b in "ACGT")
        + " from b1 group by tid, place), r as (select *, "
        + ", ".join(f"case when n > 255 then cast(trunc(254.0 * c_{b} / n + 0.5) as bigint) else c_{b} end as n_{b}" for b in "acgt")
        + " from s) select tid, place, n, "
        + ", ".join(f"round({cost(i, j)} + 1.2345678e-7, 4) as p_{'acgt'[i]}{'acgt'[j]}" for i, j in V.GENOTYPES)
        + " from r"
    )


def likelihood_records(spark: SparkSession, d: str) -> DataFrame:
    """Likelihoods as records of files, and read again from these."""
    from cytoframe.sources import likelihoods as G

    # written once, as dealing rows to files by ranges looks at them twice
    rows = V.genotype_likelihoods(written(_sites(spark, d), "sites"))
    least, lk = G.whole_likelihoods(F.col("likelihoods"))
    none = F.lit(None)
    rows = rows.select(
        F.col("tid").cast("string").alias("name"), F.lit(FOLDED).cast("bigint").alias("length"), (F.col("place") + 1).cast("bigint").alias("pos"), F.lit("site").alias("kind"), letter(F.col("place") * 7 + F.col("tid")).alias("ref"), F.col("n").alias("depth"), F.lit(60).alias("rms_mapq"),
        least.alias("min_lk"), lk.alias("lk"), none.cast("int").alias("indel1"), none.cast("int").alias("indel2"), none.cast("string").alias("seq1"), none.cast("string").alias("seq2"),
    )
    read = G.unpacked_likelihoods(G.likelihood_contents(rows, parts=8))
    return read.select("name", "pos", "ref", "depth", "min_lk", F.array_join(F.col("lk").cast("array<string>"), ",").alias("lk"))


LIKELIHOOD_RECORDS = (
    _genotypes_sql()
    + f""", m as (select *, least({", ".join(_PLS)}) as low from g)
 select cast(tid as varchar) as name, cast(place + 1 as bigint) as pos, substr('ACGT', cast((place * 7 + tid) % 4 + 1 as int), 1) as ref, n as depth, cast(least(floor(round(low, 6) + cast(0.5 as double)), 255) as int) as min_lk,
  {" || ',' || ".join(f"cast(least(floor(round({p} - low, 6) + cast(0.5 as double)), 255) as int)" for p in _PLS)} as lk from m"""
)


def _coloured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads with letters, colours (after the adaptor T) and their qualities."""
    for batch in batches:
        part, order, n = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("l_partkey", "l_orderkey", "qlen"))
        read, q = ranges(np.zeros(len(n), np.int64), n)
        begin = np.concatenate([[0], np.cumsum(n)])
        seen = np.full(int(begin[-1]) + len(n), ord("T"), np.uint8)
        seen[np.arange(len(read)) + read + 1] = 48 + (part[read] + q * 5) % 4
        each = [(np.frombuffer(b"ACGT", np.uint8)[(part[read] + q * 7 + order[read]) % 4], begin), (seen, begin + np.arange(len(begin))), ((40 + (order[read] + q) % 20).astype(np.uint8), begin)]
        texts = [pa.StringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(x)) for x, at in each]
        yield pa.RecordBatch.from_arrays([*batch.columns, *texts], names=[*batch.schema.names, "seq", "cs", "cq"])


def colour_errors(spark: SparkSession, d: str) -> DataFrame:
    """Each read's colours that its bases don't explain, as a string, with the last colour's quality."""
    rows = reads(spark, d).select(*TIES, "qlen", (F.col("flag").bitwiseAND(16) != 0).alias("reverse"))
    rows = rows.mapInArrow(_coloured, T.StructType([*rows.schema.fields, *(T.StructField(c, T.StringType()) for c in ("seq", "cs", "cq"))]))
    return V.colour_errors(rows, TIES)


_AT = lambda q: f"substr('ACGT', cast((l_partkey + ({q}) * 7 + l_orderkey) % 4 + 1 as int), 1)"
COLOUR_ERRORS = (
    with_views("reads")
    + f""", b as (select {", ".join(TIES)}, qlen, (flag & 16) <> 0 as reverse, unnest(range(qlen)) as i from reads),
 c as (select *, (l_partkey + (case when reverse then qlen - 1 - i else i end) * 5) % 4 as seen, {_AT("i")} as own, case when reverse and i = qlen - 1 then 'A' when reverse then {_AT("i + 1")} when i = 0 then 'T' else {_AT("greatest(i - 1, 0)")} end as before from b),
 e as (select *, xor(strpos('ACGT', before) - 1, strpos('ACGT', own) - 1) as right_one from c)
 select {", ".join(TIES)}, string_agg(case when seen = right_one then '-' else cast(seen as varchar) end, '' order by i) as errors, chr(cast(40 + (l_orderkey + case when max(reverse) then 0 else max(qlen) - 1 end) % 20 as int)) as last_quality from e group by {", ".join(TIES)}"""
)


def consensus(spark: SparkSession, d: str) -> DataFrame:
    rows = V.genotype_likelihoods(_sites(spark, d)).withColumn("ref", letter(F.col("place") * 7 + F.col("tid")))
    return V.consensus(rows).select("tid", "place", "consensus", "consensus_quality", "snp_quality")


CONSENSUS = (
    _genotypes_sql()
    + f""", m as (select *, substr('ACGT', cast((place * 7 + tid) % 4 + 1 as int), 1) as ref, least({", ".join(_PLS)}) as low from g),
 c as (select tid, place, ref, unnest([{", ".join(f"cast(least(floor(round({p} - low, 6) + cast(0.5 as double)), 255) as int)" for p in _PLS)}]) as lk, unnest([{", ".join(f"'{'ACGT'[i]}{'ACGT'[j]}'" for i, j in V.GENOTYPES)}]) as gt, unnest(range(10)) as o from m),
 p as (select *, lk + case when gt = ref || ref then 0 when contains(gt, ref) then 30 else 33 end as p from c),
 r as (select *, row_number() over (partition by tid, place order by p, o) as k from p)
 select tid, place, max(case gt when 'AA' then 'A' when 'CC' then 'C' when 'GG' then 'G' when 'TT' then 'T' when 'AC' then 'M' when 'AG' then 'R' when 'AT' then 'W' when 'CG' then 'S' when 'CT' then 'Y' else 'K' end) filter (k = 1) as consensus,
  cast(least(min(p) filter (k = 2) - min(p) filter (k = 1), 255) as int) as consensus_quality, cast(least(min(p) filter (gt = ref || ref) - min(p) filter (k = 1), 255) as int) as snp_quality from r group by tid, place"""
)


def mapping_caps(spark: SparkSession, d: str) -> DataFrame:
    # a reference that most bases agree with
    rows = bases(spark, d).withColumn("ref", F.when((F.col("l_partkey") + F.col("ref_pos")) % 23 == 0, F.col("ref")).otherwise(F.col("base")))
    late = rows.where("op = 'S'").groupBy(*TIES).agg(F.sum("quality").alias("late"))
    first = sum(((5 + (F.col("l_partkey") + k * 11) % 36) for k in range(1, 5)), 5 + F.col("l_partkey") % 36)
    early = reads(spark, d).where("l_linenumber % 5 = 1").select(*TIES, first.alias("early")).distinct()
    clips = late.join(early, TIES, "full").select(*TIES, (F.coalesce("late", F.lit(0)) + F.coalesce("early", F.lit(0))).alias("clip_quality"))
    return V.mapping_caps(rows, TIES, clips)


_EARLY = " + ".join(f"5 + (l_partkey + {k * 11}) % 36" for k in range(5))
MAPPING_CAPS = (
    with_views("bases")
    + f""", r as (select *, case when (l_partkey + ref_pos) % 23 = 0 then ref else base end as near from bases),
 s as (select {", ".join(TIES)}, count(*) filter (op = 'M' and quality >= 13) + count(*) filter (op = 'M') as len, count(*) filter (op = 'M' and quality >= 13 and base <> near) as mm,
   coalesce(sum(least(quality, 33)) filter (op = 'M' and quality >= 13 and base <> near), 0) as q, coalesce(sum(quality) filter (op = 'S'), 0) + case when l_linenumber % 5 = 1 then {_EARLY} else 0 end as clip from r group by {", ".join(TIES)}),
 t as (select *, q - cast(4.343 as double) * (mm * ln(len) - lgamma(mm + 1)) + clip / cast(5 as double) as t from s)
 select {", ".join(TIES)}, case when t > 40 then -1 else cast(trunc(sqrt((40 - greatest(t, 0)) / 40) * 40 + cast(0.499 as double)) as int) end as cap from t"""
)

QUERIES = {
    "v13_edit_distances": (edit_distances, EDIT_DISTANCES),
    "x14_theta_inverse": (theta_inverse, THETA_INVERSE),
    "a30_ranked_alleles": (ranked_alleles, RANKED_ALLELES),
    "v6_count_likelihoods": (likelihoods, LIKELIHOODS),
    "v4_genotype_likelihoods": (genotypes, GENOTYPES),
    "v5_plain_model": (plain_model, _plain_model_sql()),
    "v5_dependent_model": (dependent_model, None),
    "sk19_likelihood_records": (likelihood_records, LIKELIHOOD_RECORDS),
    "x15_colour_errors": (colour_errors, COLOUR_ERRORS),
    "v6_consensus": (consensus, CONSENSUS),
    "v12_mapping_caps": (mapping_caps, MAPPING_CAPS),
    "o5_best_candidates": (best_candidates, BEST_CANDIDATES),
    "a32_majority": (majority, MAJORITY),
    "j14_site_list": (site_list, SITE_LIST),
    "v18_strand_bias": (strand_bias, STRAND_BIAS),
    "x15_colours": (colours, COLOURS),
    "p6_tags": (tags, TAGS),
    "j5_breakpoint_partitions": (neighbour_sites, NEIGHBOUR_SITES),
}
