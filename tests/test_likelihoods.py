"""Likelihood records: bytes by hand, and rows written and read again."""

import struct

import pytest
from pyspark.sql import functions as F

from cytoframe.sources import binary, likelihoods


def test_bytes_by_hand():
    site = bytes([1 << 4 | 2]) + struct.pack("<II", 9, 7 << 24 | 300) + bytes([60]) + bytes(range(10))
    indel = bytes([2 << 4]) + struct.pack("<II", 0, 3 << 24 | 300) + bytes([60]) + bytes([0, 5, 255]) + struct.pack("<hh", -2, 3) + b"ACGTT"
    body = likelihoods.MAGIC + struct.pack("<i", 2) + b"hi" + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 50) + site + indel + b"\0"
    rows = list(likelihoods.records_of(binary.packed(iter([body]))))
    assert [(r["name"], r["length"], r["pos"], r["kind"], r["ref"], r["depth"], r["rms_mapq"], r["min_lk"], r["lk"]) for r in rows] == [("c1", 50, 10, "site", "C", 300, 60, 7, list(range(10))), ("c1", 50, 10, "indel", None, 300, 60, 3, [0, 5, 255])]
    assert (rows[1]["indel1"], rows[1]["seq1"], rows[1]["indel2"], rows[1]["seq2"]) == (-2, "AC", 3, "GTT")
    assert likelihoods.packed_record(rows[0], 1) == site and likelihoods.packed_record(rows[1], 10) == indel
    with pytest.raises(ValueError, match="no likelihood"):
        list(likelihoods.records_of(binary.packed(iter([b"BAM\1" + b"\0" * 8]))))


def test_round_trip(spark, tmp_path):
    rows = [(f"c{k % 3}", 1_000, k + 1, "site", "ACGTN"[k % 5], k * 100_000, k % 61, k % 256, [(k * i) % 256 for i in range(10)], None, None, None, None) for k in range(400)]
    rows += [(n, 1_000, p, "indel", None, 7, 8, 9, [1, 0, 255], 2, 0, "AC", None) for n, p in (("c1", 2), ("c1", 5), ("c2", 900))]
    frame = spark.createDataFrame(rows, likelihoods.ROWS)
    for r in likelihoods.likelihood_contents(frame, parts=4, text="head").collect():
        (tmp_path / f"{r.part}.glf").write_bytes(r.content)
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(likelihoods.read_likelihoods(spark, str(tmp_path))) == shown(frame.withColumn("depth", F.least("depth", F.lit(0xFFFFFF))).select(*frame.columns))
    assert likelihoods.likelihood_contents(frame.where("false"), parts=2).count() == 0
