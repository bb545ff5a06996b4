"""A stream of bases by position: what is given out when, late reads, and going on from a checkpoint."""

from collections import Counter

import numpy as np
import pytest

from cytoframe.plans.stream_queries import ROCKSDB
from cytoframe.streaming import pileup

SCHEMA = "tid int, start bigint, ref_pos bigint, base string, reverse boolean, final boolean"


def read(tid, start, length, base="A", reverse=False):
    return [(tid, start, start + k, "ACGTN"[("ACGT".index(base) + k) % 5], reverse, False) for k in range(length)]


def plain(rows):
    out = Counter()
    for tid, _, at, base, reverse, final in rows:
        if not final and base in "ACGT":
            out[tid, at, f"n_{base.lower()}"] += 1
            if reverse:
                out[tid, at, f"r_{base.lower()}"] += 1
    return out


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_places_are_given_out_once_and_late_ones_apart(spark, rocksdb, tmp_path):
    pieces = [
        [*read(0, 10, 8), *read(0, 12, 5, "C", True), *read(1, 5, 4)],
        [*read(0, 14, 8, "G"), *read(1, 7, 300), *read(0, 14, 3)],
        [*read(0, 11, 6, "T"), *read(0, 40, 3)],  # the first begins before what has been given out
        [(0, None, None, None, None, True), (1, None, None, None, None, True)],
    ]
    seen: list = []
    per_run = []

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        before = len(seen)
        query = pileup.streamed_counts(stream).writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        per_run.append(seen[before:])

    for piece in pieces:
        # each piece is a run of its own, which goes on from the one before
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    want, got = plain([r for p in pieces for r in p]), Counter()
    for r in seen:
        for n in pileup.NAMES:
            if r[n]:
                got[r.tid, r.ref_pos, n] += r[n]
    assert got == want
    on_time = [(r.tid, r.ref_pos) for r in seen if not r.late]
    assert len(on_time) == len(set(on_time))
    # the first run ends at the last begin: what lies before it is closed
    assert sorted((r.tid, r.ref_pos) for r in per_run[0]) == [(0, 10), (0, 11)]
    assert sorted((r.tid, r.ref_pos) for r in per_run[1] if r.tid == 1) == [(1, 5), (1, 6)]
    assert sorted(r.ref_pos for r in per_run[2] if r.late) == [11, 13] and all(r.tid == 0 for r in per_run[2])


def test_counts_by_place():
    at, counts = pileup._summed(np.array([5, 5, 7, 5]), np.array([0, 4, 3, 7]))
    assert at.tolist() == [5, 7] and counts.tolist() == [[2, 0, 0, 1, 1, 0, 0, 1], [0, 0, 0, 1, 0, 0, 0, 0]]


def test_streamed_reads_equal_streamed_bases(spark, rocksdb, tmp_path):
    from pyspark.sql import functions as F

    from cytoframe.plans import adapters

    rows = [(k % 2, 1 + 3 * k, 16 * (k % 3 == 0), 12 + k % 5, 7 * k, 11 * k, ["20M", "3S9M2D4M", "5M30N6M2S"][k % 3], False) for k in range(60)]
    schema = "tid int, pos bigint, flag int, least int, l_partkey bigint, l_orderkey bigint, cigar string, final boolean"
    reads = spark.createDataFrame([*rows, *[(t, *[None] * 6, True) for t in range(2)]], schema)
    for k, part in enumerate((reads.where("pos < 100 and not final"), reads.where("pos >= 100 and not final"), reads.where("final"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen: list = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # s4_streamed_counts brought a row for each base to the state, and added up all open places for each batch of rows
    counted = pileup.streamed_read_counts(stream, adapters.LOOKED_AT, adapters.base_arrays)
    counted.writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = Counter({(r.tid, r.ref_pos, n): r[n] for r in seen for n in pileup.NAMES if r[n]})
    bases = adapters.bases(spark, "", source=reads.where("not final"), ops="MS", keep=["tid", "pos", "flag", "least", "l_partkey", "l_orderkey"], ends=False).where("quality >= least")
    want = Counter()
    for r in bases.collect():
        want[r.tid, r.ref_pos, f"n_{r.base.lower()}"] += 1
        if r.reverse:
            want[r.tid, r.ref_pos, f"r_{r.base.lower()}"] += 1
    assert got == want and sum(want.values()) > 300
