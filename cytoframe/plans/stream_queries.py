"""Streams over the events table run to their end, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.operators import pileup as U
from cytoframe.plans.adapters import LOOKED_AT, base_arrays, reads, table
from cytoframe.plans.read_queries import ALLELE_COUNTS
from cytoframe.session import shared_path
from cytoframe.streaming import pileup, windows


def _stream(spark: SparkSession, d: str) -> DataFrame:
    # a pattern, so that a single file can be a stream as well as a folder
    return windows.stream_table(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema)


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = windows.run_available(windows.tumbling(_stream(spark, d), by="event_type", value="value"), "tumbling")
    return out.select("event_type", F.date_format("begin", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


TUMBLING = "select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n, round(sum(value), 4) as total from events group by all"


def sliding(spark: SparkSession, d: str) -> DataFrame:
    out = windows.run_available(windows.sliding(_stream(spark, d)), "sliding")
    return out.select(F.date_format("begin", "yyyy-MM-dd").alias("day"), "n")


SLIDING = "select strftime(day, '%Y-%m-%d') as day, count(*) as n from (select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as day from events) group by 1"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    out = windows.run_available(windows.sessions(_stream(spark, d), by="user_id"), "sessions")
    return out.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"), F.max("n").alias("longest"))


SESSIONS = """with x as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as f from events window w as (partition by user_id order by ts)),
 y as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as s from x), z as (select user_id, s, count(*) as n from y group by all)
 select user_id, count(*) as n_sessions, cast(sum(n) as bigint) as n, max(n) as longest from z group by user_id"""

#: Files that reads are dealt to by position, and files that a batch of the stream takes.
PIECES, A_BATCH = 6, 2
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Allele counts of reads that come in order of position, a few files a batch; each place once, but for what comes late."""
    good = reads(spark, d).where("mapq > 0 and (flag & 1024) = 0").withColumn("least", U.least_quality(F.col("mapq"))).where("least is not null")
    path = shared_path(spark, "ordered-reads")
    columns = ["tid", "pos", "flag", "least", "l_partkey", "l_orderkey", "cigar", "final"]
    good.withColumn("final", F.lit(False)).repartitionByRange(PIECES, "pos").sortWithinPartitions("pos").select(*columns).write.parquet(path)
    ends = [F.lit(None).cast(good.schema[c].dataType).alias(c) for c in columns[1:-1]]
    schema = spark.read.parquet(path).schema
    good.select("tid").distinct().select("tid", *ends, F.lit(True).alias("final")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", A_BATCH).parquet(path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = windows.run_available(pileup.streamed_read_counts(stream, LOOKED_AT, base_arrays), "counts", mode="append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.groupBy("tid", "ref_pos").agg(*[F.sum(n).alias(n) for n in pileup.NAMES])


QUERIES = {"s4_streamed_counts": (streamed_counts, ALLELE_COUNTS), "s1_tumbling": (tumbling, TUMBLING), "s2_sliding": (sliding, SLIDING), "s3_sessions": (sessions, SESSIONS)}
