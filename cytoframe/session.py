"""Session defaults for local runs, and the shared folder; on a cluster the caller brings its own session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "cytoframe") -> SparkSession:
    """A local[N] session with adaptive execution, UTC time and shuffle partitions to match the cores."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CYTOFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named in spark.checkpoint.dir; in a temporary one only where the setting is absent and Spark runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = getattr(spark, "_cytoframe_shared", None)
        if at is None:
            at = spark._cytoframe_shared = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{at.rstrip('/')}/cytoframe-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows doesn't compute it anew, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``shared_path`` gave, in whatever file system it lies."""
    if "/cytoframe-" not in path:
        raise ValueError(f"not a path of this package: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
