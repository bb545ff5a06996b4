"""Queries over partitions, intervals and sequences, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.operators import copynumber as M
from cytoframe.operators import intervals as I
from cytoframe.operators import profile
from cytoframe.plans.adapters import TIES, mutations, partitions, reads, segments, table, with_views


def _begun(spark: SparkSession, d: str) -> DataFrame:
    """Reads with the reference's base where they begin, unknown at some places."""
    return reads(spark, d).withColumn("ref", F.when(F.col("pos") % 53 == 0, "N").otherwise("A"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return M.partition_counts(_begun(spark, d), partitions(spark), ref="ref").join(partitions(spark).drop("tid"), "part_no")


_COUNTS = """, counts as (select p.*, count(r.pos) filter (sample = 'T') as n_t, count(r.pos) filter (sample = 'N') as n_n
 from partitions p left join (select tid, (pos - 1) // 1000 as bin, pos, sample from reads where mapq > 0 and pos % 53 <> 0) r on p.tid = r.tid and p.bin = r.bin group by all)"""


def partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.partition_counts(_begun(spark, d), partitions(spark), ref="ref").select("part_no", "n_t", "n_n")


PARTITION_COUNTS = with_views("reads", "partitions") + _COUNTS + " select part_no, n_t, n_n from counts"


def gc_fraction(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).select("tid", F.floor((F.col("pos") - 1) / 1000).cast("bigint").alias("bin"), F.expr("case when tid % 7 = 3 then 'N' else substring('ACGT', cast((l_partkey + l_orderkey) % 4 + 1 as int), 1) end").alias("base"), F.lit(1).alias("n"))
    return M.gc_fraction(rows, ["tid", "bin"]).select("tid", "bin", F.round("gc", 9).alias("gc"))


GC_FRACTION = with_views("reads") + " select tid, (pos - 1) // 1000 as bin, case when max(tid % 7) = 3 then cast(-1 as double) else round(count(*) filter ((l_partkey + l_orderkey) % 4 in (1, 2)) / cast(count(*) as double), 9) end as gc from reads group by all"


def genome_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.genome_totals(_counts(spark, d)).withColumn("ratio_n_t", F.round("ratio_n_t", 9))


GENOME_TOTALS = (
    with_views("reads", "partitions")
    + _COUNTS
    + " select cast(sum(p_end - p_start + 1) as bigint) as genome_size, cast(sum(n_t) as bigint) as reads_t, cast(sum(n_n) as bigint) as reads_n, round(cast(sum(n_n) as double) / sum(n_t), 9) as ratio_n_t, case when avg(n_t / cast(1000 as double)) filter (tid = 23) / avg(n_t / cast(1000 as double)) filter (tid = 22) < 0.2 and avg(n_t) filter (tid = 22) > 0 then 'f' else 'm' end as sex from counts"
)


def gc_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = _counts(spark, d).withColumn("gc", F.col("gc_permille") / 1000.0)
    return M.gc_bins(rows, "n_n", bins=200).select("gc_bin", F.col("median_value").cast("double").alias("median_value"), F.round("weight", 9).alias("weight"))


GC_BINS = with_views("reads", "partitions") + _COUNTS + " select cast(floor(gc_permille / cast(1000 as double) * 200) as int) as gc_bin, cast(median(n_n) as double) as median_value, round(sqrt(count(*)), 9) as weight from counts group by 1"


def gc_variance(spark: SparkSession, d: str) -> DataFrame:
    rows = _counts(spark, d).withColumn("gc", F.col("gc_permille") / 1000.0).withColumn("residual", F.log1p(F.col("n_n").cast("double")) - 1.0)
    return M.gc_variance(rows, "residual").select("gc_bin", F.round("variance", 7).alias("variance"))


GC_VARIANCE = (
    with_views("reads", "partitions")
    + _COUNTS
    + ", g as (select cast(floor(gc_permille / cast(1000 as double) * 100) as int) as gc_bin, avg(pow(ln(1 + n_n) - 1, 2)) as v, count(*) as n from counts group by 1) select gc_bin, round(coalesce(case when n > 5 then v end, max(case when n > 5 then v end) over (), 0), 7) as variance from g"
)


def first_match(spark: SparkSession, d: str) -> DataFrame:
    two = segments(spark).unionByName(segments(spark).withColumn("s_end", F.col("s_end") + 30_000).withColumn("seg_id", F.col("seg_id") + 1_000)).where("(seg_id % 1000) % 7 <> 3")
    return I.first_match(mutations(spark, d), two, key=["mut_key"], group="tid", at="pos", begin="s_start", end="s_end", ordinal="seg_id", width=50_000)


FIRST_MATCH = with_views("mutations", "segments") + ", two as (select tid, s_start, s_end, seg_id from segments union all select tid, s_start, s_end + 30000, seg_id + 1000 from segments) select mut_key, coalesce(min(seg_id), -1) as seg_id from mutations m left join two s on m.tid = s.tid and pos between s_start and s_end and (seg_id % 1000) % 7 <> 3 group by mut_key"


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).select("tid", *TIES, F.col("pos").alias("r_start"), (F.col("pos") + F.col("qlen") * 50).alias("r_end"))
    hit = I.overlap_join(rows, segments(spark).select("tid", "seg_id", "s_start", "s_end"), group="tid", begin=("r_start", "s_start"), end=("r_end", "s_end"), width=20_000)
    return hit.groupBy("seg_id").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("part_sum"))


OVERLAPS = with_views("reads", "segments") + " select seg_id, count(*) as n, cast(sum(l_partkey) as bigint) as part_sum from reads r join segments s on r.tid = s.tid and r.pos <= s_end and s_start <= r.pos + qlen * 50 group by seg_id"


def segment_lookup(spark: SparkSession, d: str) -> DataFrame:
    window = segments(spark).select(F.col("seg_id"), F.explode(F.sequence(F.col("seg_id") * 100, F.col("seg_id") * 100 + 99)).alias("part_no"), "icn")
    return _counts(spark, d).join(window, "part_no").groupBy("seg_id", "icn").agg(F.sum("n_t").alias("n_t"), F.sum("n_n").alias("n_n"))


SEGMENT_LOOKUP = with_views("reads", "partitions", "segments") + _COUNTS + " select seg_id, icn, cast(sum(n_t) as bigint) as n_t, cast(sum(n_n) as bigint) as n_n from counts c join segments s on c.tid = s.tid and c.bin // 100 = s.seg group by all"


def running_median(spark: SparkSession, d: str) -> DataFrame:
    rows = _counts(spark, d).select("part_no", "n_t")
    return I.running_median(rows, "n_t", ordinal="part_no", half=3, n=24_000).select("part_no", "n_t_median")


RUNNING_MEDIAN = (
    with_views("reads", "partitions")
    + _COUNTS
    + ", e as (select part_no as p, n_t from counts union all select -part_no, n_t from counts where part_no between 1 and 3 union all select 2 * 23999 - part_no, n_t from counts where part_no between 23996 and 23998) select p as part_no, cast(m as bigint) as n_t_median from (select p, median(n_t) over (order by p rows between 3 preceding and 3 following) as m from e) where p between 0 and 23999"
)


def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = _counts(spark, d).select("tid", "part_no", F.when(F.col("n_t") > 2, F.col("n_t")).alias("level"))
    return I.forward_fill(rows, "level", group=["tid"], order=["part_no"]).select("part_no", F.coalesce("level", F.lit(-1)).alias("level"))


FORWARD_FILL = with_views("reads", "partitions") + _COUNTS + ", x as (select tid, part_no, case when n_t > 2 then n_t end as v from counts) select part_no, coalesce(last_value(v ignore nulls) over (partition by tid order by part_no), first_value(v ignore nulls) over (partition by tid order by part_no rows between current row and unbounded following), -1) as level from x"


def run_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = _counts(spark, d).withColumn("level", F.least(F.col("n_t"), F.lit(2)))
    out = I.run_lengths(rows, group=["tid"], order=["part_no"], by=["level"], begin="p_start", end="p_end", value="n_n")
    return out.select("tid", "run", "level", "p_start", "p_end", "n", F.round("mean_value", 9).alias("mean_value"))


RUN_SEGMENTS = (
    with_views("reads", "partitions")
    + _COUNTS
    + """, x as (select *, least(n_t, 2) as level from counts), y as (select *, case when lag(level) over w is null or lag(level) over w = level then 0 else 1 end as f from x window w as (partition by tid order by part_no)),
 z as (select *, sum(f) over (partition by tid order by part_no) as run from y)
 select tid, cast(run as bigint) as run, level, min(p_start) as p_start, max(p_end) as p_end, count(*) as n, round(avg(n_n), 9) as mean_value from z group by tid, run, level"""
)


def breakpoints(spark: SparkSession, d: str) -> DataFrame:
    points = mutations(spark, d).select("tid", (F.floor(F.col("pos") / 1000) * 1000).alias("place"))
    return I.breakpoint_pairs(points, group="tid", at="place")


BREAKPOINTS = with_views("mutations") + " select * from (select tid, place, lead(place) over (partition by tid order by place) as next_at from (select distinct tid, pos // 1000 * 1000 as place from mutations)) where next_at is not null"


def part_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).groupBy("tid").agg(F.count("*").alias("n"))
    return I.group_offsets(rows, order="tid", n="n")


PART_OFFSETS = with_views("reads") + " select tid, n, cast(coalesce(sum(n) over (order by tid rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from (select tid, count(*) as n from reads group by tid)"


def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return I.local_maxima(_counts(spark, d).select("tid", "part_no", "n_n"), "n_n", group=["tid"], order="part_no")


LOCAL_MAXIMA = with_views("reads", "partitions") + _COUNTS + " select tid, part_no, n_n from (select *, n_n - lag(n_n) over w as a, lead(n_n) over w - n_n as b from counts window w as (partition by tid order by part_no)) where a > 0 and b <= 0"


def merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = mutations(spark, d).select("tid", F.col("pos").alias("b"), (F.col("pos") + F.col("dp") * 40).alias("e"))
    return I.merge_chunks(rows, group=["tid"], begin="b", end="e")


MERGED_CHUNKS = (
    with_views("mutations")
    + """, x as (select tid, pos as b, pos + dp * 40 as e from mutations), y as (select *, case when max(e) over (partition by tid order by b, e rows between unbounded preceding and 1 preceding) >= b then 0 else 1 end as f from x),
 z as (select *, sum(f) over (partition by tid order by b, e rows between unbounded preceding and current row) as k from y) select tid, min(b) as b, max(e) as e, count(*) as n from z group by tid, k"""
)


def greedy_windows(spark: SparkSession, d: str) -> DataFrame:
    return profile.genome_windows(_counts(spark, d), least_length=5_000, least_reads=8).select("part_no", "window", "counted", "with_gc", F.col("so_far").cast("bigint").alias("so_far"), "ends")


GREEDY_WINDOWS = (
    "with recursive "
    + with_views("reads", "partitions").removeprefix("with ")
    + _COUNTS
    + """, walk as (select part_no, tid, 0 as w, 0 as c, true as g, cast(1000 as bigint) as len, n_n as seen, false as e, 1000 >= 5000 and n_n >= 8 as shut from counts where part_no = 0
 union all select n.part_no, n.tid,
  case when w.shut then case when n.tid = w.tid then w.c + 1 else w.c + 1 end else w.c end,
  case when n.tid <> w.tid and not w.shut and w.seen > 0 then w.c + 1 when w.shut then w.c + 1 else w.c end,
  not (n.tid <> w.tid and (w.shut or w.seen = 0)),
  case when w.shut then 0 else w.len end + 1000,
  case when w.shut or n.tid <> w.tid then 0 else w.seen end + n.n_n,
  n.tid <> w.tid,
  n.tid = w.tid and case when w.shut then 0 else w.len end + 1000 >= 5000 and case when w.shut then 0 else w.seen end + n.n_n >= 8
  from walk w join counts n on n.part_no = w.part_no + 1)
 select part_no, cast(w as bigint) as "window", cast(c as bigint) as counted, g as with_gc, len as so_far, e as ends from walk"""
)


def events_by_user(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    runs = I.islands(rows, group=["user_id"], order=["ts", "event_id"], by=["event_type"])
    return runs.groupBy("user_id").agg((F.max("run") + 1).alias("n_runs"), F.count("*").alias("n"))


EVENTS_BY_USER = "select user_id, cast(1 + sum(f) as bigint) as n_runs, count(*) as n from (select user_id, case when lag(event_type) over w <> event_type then 1 else 0 end as f from events window w as (partition by user_id order by ts, event_id)) group by user_id"

QUERIES = {
    "a1_partition_counts": (partition_counts, PARTITION_COUNTS),
    "a2_gc_fraction": (gc_fraction, GC_FRACTION),
    "a5_genome_totals": (genome_totals, GENOME_TOTALS),
    "a9_gc_bins": (gc_bins, GC_BINS),
    "a10_gc_variance": (gc_variance, GC_VARIANCE),
    "j4_first_match": (first_match, FIRST_MATCH),
    "j5_overlaps": (overlaps, OVERLAPS),
    "j8_segment_lookup": (segment_lookup, SEGMENT_LOOKUP),
    "w1_running_median": (running_median, RUNNING_MEDIAN),
    "w4_forward_fill": (forward_fill, FORWARD_FILL),
    "w5_run_segments": (run_segments, RUN_SEGMENTS),
    "w5_event_runs": (events_by_user, EVENTS_BY_USER),
    "w7_breakpoints": (breakpoints, BREAKPOINTS),
    "w8_local_maxima": (local_maxima, LOCAL_MAXIMA),
    "w9_part_offsets": (part_offsets, PART_OFFSETS),
    "w14_merged_chunks": (merged_chunks, MERGED_CHUNKS),
    "a7_greedy_windows": (greedy_windows, GREEDY_WINDOWS),
}
