"""Helpers that the corpus operators share: shared-folder tables, batch slicing, text keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.session import remove_path, shared_path

#: Code points of text that a Python worker turns into objects at once.
SLICE_CHARS = 1_000_000
#: Bytes of an Arrow batch that goes to a Python worker while a table is stored; a single row may be larger.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What Spark runs inside sends at most so many bytes to a worker at once, or as many as the session says if those are fewer."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    most = int(before[:-1] if before.endswith("b") else before) if before.rstrip("b").lstrip("-").isdigit() else -1
    spark.conf.set(name, str(min(size, most) if most > 0 else size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_files(spark: SparkSession) -> int:
    """Files that a table of evenly dealt rows is written to at most: four waves of tasks, or an eighth of the shuffle partitions if that is more."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def stored(df: DataFrame, name: str, *, even: bool = False) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors.

    even: no key has many of its rows, so that neighbouring partitions may be written by one task. With every file
    executors may start processes (in local folders), each of which is for a moment counted as large as its executor.
    """
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        (df.coalesce(few_files(df.sparkSession)) if even else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing is to be read from any more."""
    for df in tables:
        remove_path(df.sparkSession, df._stored_path)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text: equal for equal texts, null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with at most so many code points together, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def texts_of(column: pa.Array) -> list[str]:
    """The column's strings, null as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches, each with its texts, so that very long texts don't meet in one go."""
    for batch in batches:
        step = max(1, min(batch.num_rows, 2_000))
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            texts = texts_of(some.column(text))
            for i, j in slices(texts):
                yield some.slice(i, j - i), texts[i:j]
        pa.default_memory_pool().release_unused()  # workers outlive their tasks


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
