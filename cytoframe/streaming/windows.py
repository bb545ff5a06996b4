"""Windowed aggregates that run alike over tables and streams, and bounded runs of a stream.

The reference's scans are bounded and sorted; these functions are an extension for feeds that arrive in pieces. State
is bounded by the watermark: what is later than it is dropped by a stream (a table has no late rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cytoframe.session import shared_path


def tumbling(events: DataFrame, *, by: str, value: str, width: str = "1 day", late: str = "2 days", at: str = "ts") -> DataFrame:
    """by, begin of the window, rows and sum of value."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = rows.groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(by, F.col("window.start").alias("begin"), "n", "total")


def sliding(events: DataFrame, *, width: str = "2 days", slide: str = "1 day", late: str = "2 days", at: str = "ts") -> DataFrame:
    """Begin of each overlapping window and its rows."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), "n")


def sessions(events: DataFrame, *, by: str, gap: str = "6 hours", late: str = "2 days", at: str = "ts") -> DataFrame:
    """by, begin of each session (rows less than gap apart) and its rows."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = rows.groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("begin"), "n")


def stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the rows of a parquet folder, one file after another."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs what is there of a stream to its end and returns the result of the last batch, as a table in the shared folder.

    Each batch writes a folder of its own by number, so a batch that is tried again replaces what it had written.
    """
    spark = stream.sparkSession
    out, seen = shared_path(spark, name), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        seen.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    last = seen[-1:] if mode == "complete" else sorted(set(seen))
    return spark.read.schema(stream.schema).parquet(*[f"{out}/{k}" for k in last])
