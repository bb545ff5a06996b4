"""Sharding by Karmarkar-Karp differencing, with groups of equal texts kept whole.

Groups of equal texts are weighed by pre-aggregated bytes. Each task sorts its own groups by weight and, batch
by batch, turns them into one partial partition of ``shards`` sums: it repeatedly takes the two partial
partitions with the largest spread and joins them oppositely ordered, the heaviest part of one with the lightest
of the other. The batches' partial partitions (a row of ``shards`` sums each) are differenced in the same way
in rounds of bounded groups until one is left. What remains is a map from (batch, part) to shard.

Slots within a shard come from counts of hash buckets of bounded size and their running sums, so that no task
numbers a whole shard.

Law: ``bytes``. Sizes come out near equal wherever no single group outweighs a shard's share; such a group
stays whole, and the rest is balanced around it.

Defined results: a null text counts as an empty one (16 bytes, crc32 0); equal rows are rows of one group and
get slots of their own; null ids are kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoframe.llm.common import stored, text_key

#: Groups that one batch holds, and partial partitions that one task joins.
BATCH = 20_000
FAN_IN = 400
#: Rows of a bucket that one task numbers, about.
BUCKET = 20_000
ROW_BYTES = 16


def difference(sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Joins partial partitions by largest spread. Returns the final sums, and per input the part each of its parts went to.

    An input is an array of part sums; all have the same length. Ties go by order of input, so the result is
    the same for the same list.
    """
    k = len(sums[0])
    tick = count()
    heap = []
    for i, s in enumerate(sums):
        order = np.argsort(-s, kind="stable")
        heap.append((-int(s[order[0]] - s[order[-1]]), next(tick), s[order], i))
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray]] = []
    slots = {i: np.argsort(-s, kind="stable") for i, s in enumerate(sums)}
    n = len(sums)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = a + b[::-1]
        order = np.argsort(-both, kind="stable")
        joined.append((x, y, order))
        heapq.heappush(heap, (-int(both[order[0]] - both[order[-1]]), next(tick), both[order], n))
        n += 1
    # where each part of a node ends up, from the root down
    place = {n - 1: np.arange(k)}
    for node in range(n - 1, len(sums) - 1, -1):
        x, y, order = joined[node - len(sums)]
        at = place.pop(node)
        to = np.empty(k, np.int64)
        to[order] = at  # part before sorting -> final part
        place[x], place[y] = to, to[::-1]
    out = []
    for i in range(len(sums)):
        to = np.empty(k, np.int64)
        to[slots[i]] = place[i]
        out.append(to)
    return heap[0][2], out


def _local(shards: int):
    """mapInArrow function: groups (key, bytes) sorted by weight -> key, batch, part, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        keys: list[bytes] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            single = [np.concatenate([[s], np.zeros(shards - 1, np.int64)]) for s in sizes]
            _, to = difference(single)
            columns = [pa.array(keys, pa.binary()), pa.array([f"{task}-{number}"] * len(keys)), pa.array([int(t[0]) for t in to], pa.int32()), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["key", "batch", "part", "bytes"])

        for b in batches:
            keys += b.column("key").to_pylist()
            sizes += b.column("bytes").to_pylist()
            while len(keys) >= BATCH:
                rest = keys[BATCH:], sizes[BATCH:]
                keys, sizes = keys[:BATCH], sizes[:BATCH]
                yield flush()
                (keys, sizes), number = rest, number + 1
        if keys:
            yield flush()

    return run


def _merge(shards: int):
    """applyInPandas function: rows (batch, part, bytes) of up to FAN_IN batches -> one partial partition, and where each part went."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot_table(index="batch", columns="part", values="bytes", aggfunc="sum", fill_value=0)
        wide = wide.reindex(columns=range(shards), fill_value=0).sort_index()
        sums, to = difference([row.astype(np.int64) for row in wide.to_numpy()])
        out = [(b, part, int(t[part]), int(sums[t[part]]), frame["up"].iat[0]) for b, t in zip(wide.index, to) for part in range(shards)]
        return pd.DataFrame(out, columns=["batch", "part", "to", "total", "up"])

    return run


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """groups: key, bytes -> key, shard. A tree of differencing; the map of parts stays a table."""
    # bytes before keys: each task's order is fixed, so a lost task gives the same batches again
    sorted_ = groups.repartition("key").sortWithinPartitions(F.desc("bytes"), "key")
    local = stored(sorted_.mapInArrow(_local(shards), "key binary, batch string, part int, bytes bigint"), "shards")
    sums = local.groupBy("batch", "part").agg(F.sum("bytes").alias("bytes"))
    where = local.select("batch", "part").distinct().select("batch", "part", F.col("batch").alias("top"), F.col("part").alias("at"))
    n = sums.select("batch").distinct().count()
    while n:
        up = F.pmod(F.xxhash64("batch"), F.lit(-(-n // FAN_IN))).cast("string")
        joined = stored(
            sums.withColumn("up", up).groupBy("up").applyInPandas(_merge(shards), "batch string, part int, to int, total bigint, up string"),
            "shard-sums",
        )
        step = joined.select(F.col("batch").alias("top"), F.col("part").alias("at"), F.col("up"), F.col("to"))
        where = where.join(step, ["top", "at"]).select("batch", "part", F.col("up").alias("top"), F.col("to").alias("at"))
        if n == 1 or -(-n // FAN_IN) == 1:
            break
        sums = joined.groupBy(F.col("up").alias("batch"), F.col("to").alias("part")).agg(F.max("total").alias("bytes"))
        n = sums.select("batch").distinct().count()
    return local.select("key", "batch", "part").join(where, ["batch", "part"]).select("key", F.col("at").alias("shard"))


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("key")
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    placed = rows.join(assign_groups(groups, shards), "key").drop("key")
    placed = stored(placed, "sharded")
    buckets = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, placed.count() // (BUCKET * shards) + 1)))
    placed = placed.withColumn("bucket", buckets)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    inner = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = placed.withColumn("inner", inner).join(starts, ["shard", "bucket"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("inner") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
