"""Interval joins and order-dependent column operations.

Intervals are joined by bins: each interval is listed under every bin of ``width`` positions that it touches, so that
the join has an equality on (group, bin) and shuffles or broadcasts as Spark sees fit; a hot chromosome spreads over
its bins. Windows without a grouping column work in blocks of an ordinal, so no task gets the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bins(begin: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(begin / width), F.floor(F.greatest(begin, end) / width)))


def range_join(points: DataFrame, intervals: DataFrame, *, group: str, at: str, begin: str, end: str, width: int = 10_000, how: str = "inner") -> DataFrame:
    """Points joined to every interval of their group that holds them (both ends included).

    how: ``inner``, or ``left`` to keep points in no interval.
    """
    binned = intervals.withColumn("_bin", _bins(F.col(begin), F.col(end), width)).withColumnRenamed(group, "_group")
    rows = points.withColumn("_at_bin", F.floor(F.col(at) / width))
    on = (F.col(group) == F.col("_group")) & (F.col("_at_bin") == F.col("_bin")) & (F.col(at) >= F.col(begin)) & (F.col(at) <= F.col(end))
    return rows.join(binned, on, how).drop("_bin", "_at_bin", "_group")


def overlap_join(left: DataFrame, right: DataFrame, *, group: str, begin: tuple[str, str], end: tuple[str, str], width: int = 10_000) -> DataFrame:
    """Pairs of intervals of one group that overlap (both ends included), each pair once."""
    a = left.withColumn("_bin", _bins(F.col(begin[0]), F.col(end[0]), width))
    b = right.withColumn("_bin_b", _bins(F.col(begin[1]), F.col(end[1]), width)).withColumnRenamed(group, "_group")
    first = F.greatest(F.floor(F.col(begin[0]) / width), F.floor(F.col(begin[1]) / width))
    on = (F.col(group) == F.col("_group")) & (F.col("_bin") == F.col("_bin_b")) & (F.col("_bin") == first)
    touch = (F.col(begin[0]) <= F.col(end[1])) & (F.col(begin[1]) <= F.col(end[0]))
    return a.join(b, on & touch).drop("_bin", "_bin_b", "_group")


def first_match(points: DataFrame, intervals: DataFrame, *, key: list[str], group: str, at: str, begin: str, end: str, ordinal: str, width: int = 10_000) -> DataFrame:
    """key and the lowest ordinal among the intervals that hold each point (-1: none)."""
    hit = range_join(points.select(*key, group, at), intervals.select(group, begin, end, ordinal), group=group, at=at, begin=begin, end=end, width=width, how="left")
    return hit.groupBy(*key).agg(F.coalesce(F.min(ordinal), F.lit(-1)).cast("bigint").alias(ordinal))


def forward_fill(df: DataFrame, column: str, *, group: list[str], order: list[str]) -> DataFrame:
    """Nulls of column take the last value before them; those before the first value take that."""
    w = W.partitionBy(*group).orderBy(*order)
    # before the first known value the first one of all comes next; over the whole frame it is worked out once
    filled = F.coalesce(F.last(column, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(column, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return df.withColumn(column, filled)


def islands(df: DataFrame, *, group: list[str], order: list[str], by: list[str], name: str = "run") -> DataFrame:
    """df with the number (from 0) of the run of equal values of ``by`` within its group, in order."""
    w = W.partitionBy(*group).orderBy(*order)
    here, before = F.struct(*by), F.lag(F.struct(*by)).over(w)
    starts = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).when(here.eqNullSafe(before), 0).otherwise(1))
    return starts.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def run_lengths(df: DataFrame, *, group: list[str], order: list[str], by: list[str], begin: str, end: str, value: str) -> DataFrame:
    """One row for each run: group, by, its first begin, last end, rows and mean value."""
    runs = islands(df, group=group, order=order, by=by)
    return runs.groupBy(*group, "run", *by).agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count("*").alias("n"), F.avg(value).alias("mean_value"))


def running_median(df: DataFrame, column: str, *, ordinal: str, half: int, n: int, block: int = 4096, name: str | None = None) -> DataFrame:
    """df with the median of 2 half + 1 rows around each, by a gapless ordinal from 0 to n - 1.

    At the ends rows are mirrored without repeating the first and last one. Each block of ordinals gets a copy of the
    rows that its edges need, so blocks are independent.
    """
    at = F.col(ordinal)
    # where a row stands in: itself, and mirrored before 0 and after n - 1
    places = F.array_distinct(F.filter(F.array(at, -at, 2 * n - 2 - at), lambda p: (p >= -half) & (p < n + half)))
    source = df.select(F.col(column).alias("_x"), F.explode(places).alias("_p"))
    blocks = F.array_distinct(F.array(*[F.floor((F.col("_p") + d) / block) for d in (-half, 0, half)]))
    copies = source.withColumn("_block", F.explode(blocks))
    w = W.partitionBy("_block").orderBy("_p").rowsBetween(-half, half)
    medians = copies.withColumn("_all", F.collect_list("_x").over(w)).where((F.floor(F.col("_p") / block) == F.col("_block")) & (F.col("_p") >= 0) & (F.col("_p") < n))
    middle = medians.select(F.col("_p").alias(ordinal), F.get(F.array_sort("_all"), F.floor(F.size("_all") / 2).cast("int")).alias(name or f"{column}_median"))
    return df.join(middle, ordinal)


def breakpoint_pairs(points: DataFrame, *, group: str, at: str) -> DataFrame:
    """Distinct points of a group in order, as intervals from each to the next."""
    w = W.partitionBy(group).orderBy(at)
    return points.select(group, at).distinct().withColumn("next_at", F.lead(at).over(w)).where("next_at is not null")


def group_offsets(counts: DataFrame, *, order: str, n: str, name: str = "offset") -> DataFrame:
    """counts (one row for each group, such as a chromosome) with the sum of n over the groups before."""
    return counts.withColumn(name, F.coalesce(F.sum(n).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))


def number_rows(df: DataFrame, *, group: str, at: str, order: list[str], width: int = 10_000, name: str = "ord") -> DataFrame:
    """df with a gapless number from 0 in the order (group, at, *order), from counts of bins and their running sums."""
    binned = df.withColumn("_bin", F.floor(F.col(at) / width))
    counts = binned.groupBy(group, "_bin").agg(F.count("*").alias("_n"))
    within = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = group_offsets(counts.groupBy(group).agg(F.sum("_n").alias("_all")), order=group, n="_all", name="_before").select(F.col(group), "_before")
    starts = counts.select(group, "_bin", within.alias("_start")).join(groups, group)
    inner = F.row_number().over(W.partitionBy(group, "_bin").orderBy(at, *order)) - 1
    return binned.withColumn("_inner", inner).join(starts, [group, "_bin"]).withColumn(name, (F.col("_before") + F.col("_start") + F.col("_inner")).cast("bigint")).drop("_bin", "_inner", "_start", "_before")


def local_maxima(df: DataFrame, value: str, *, group: list[str], order: str) -> DataFrame:
    """Rows where value rises towards them and doesn't rise after."""
    w = W.partitionBy(*group).orderBy(order)
    marked = df.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_e", F.lead(value).over(w) - F.col(value))
    return marked.where("_d > 0 and _e <= 0").drop("_d", "_e")


def merge_chunks(df: DataFrame, *, group: list[str], begin: str, end: str) -> DataFrame:
    """Touching or overlapping intervals of a group as one."""
    w = W.partitionBy(*group).orderBy(begin, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.coalesce(reach >= F.col(begin), F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "_run").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count("*").alias("n")).drop("_run")
