"""Genotype likelihood records (GLF, version 3): variable-length records in compressed blocks, each place as the distance from the one before.

Rows are dealt to files by ranges of places, sorted, and packed as they stream by; a file is complete in itself, so files are written and read side by side.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.sources import binary

# --- fixed values: the format's magic number, kinds of records and letters of reference bases ---
MAGIC = b"GLF\3"
END, SITE, INDEL = 0, 1, 2
LETTERS = "XACMGRSVTWYHKDBN"
# --- end of fixed values ---
ROWS = "name string, length bigint, pos bigint, kind string, ref string, depth bigint, rms_mapq int, min_lk int, lk array<int>, indel1 int, indel2 int, seq1 string, seq2 string"
SCHEMA = pa.schema([
    ("name", pa.string()), ("length", pa.int64()), ("pos", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("depth", pa.int64()), ("rms_mapq", pa.int32()), ("min_lk", pa.int32()), ("lk", pa.list_(pa.int32())),
    ("indel1", pa.int32()), ("indel2", pa.int32()), ("seq1", pa.string()), ("seq2", pa.string()),
])
BATCH = 5_000


def whole_likelihoods(likelihoods: Column) -> tuple[Column, Column]:
    """(least of the likelihoods, distances from it): whole numbers up to 255, halves rounded up."""
    least = F.array_min(likelihoods)
    near = lambda x: F.least(F.floor(F.round(x, 6) + 0.5), F.lit(255)).cast("int")
    return near(least), F.transform(likelihoods, lambda x: near(x - least))


def packed_record(row: dict, before: int) -> bytes:
    """One record. An indel goes with the place of the record before it; before: that record's place."""
    kind = INDEL if row["kind"] == "indel" else SITE
    ref = 0 if kind == INDEL else max(LETTERS.find((row["ref"] or "N").upper()), 0)
    out = struct.pack("<BIIB", kind << 4 | ref, row["pos"] - before, (row["min_lk"] & 0xFF) << 24 | min(row["depth"], 0xFFFFFF), row["rms_mapq"] & 0xFF) + bytes(row["lk"])
    if kind == SITE:
        return out
    return out + struct.pack("<hh", row["indel1"], row["indel2"]) + (row["seq1"] or "").encode() + (row["seq2"] or "").encode()


def records_of(data: bytes) -> Iterator[dict]:
    """Rows of a whole file."""
    stream = binary.Stream(data)
    if stream.take(4) != MAGIC:
        raise ValueError("no likelihood records")
    stream.take(stream.number())
    while stream.more():
        name, length, at = stream.take(stream.number())[:-1].decode(), stream.number(), 1
        while (head := stream.take(1)[0]) >> 4 != END:
            step, both, rms = struct.unpack("<IIB", stream.take(9))
            at += step
            row = {"name": name, "length": length, "pos": at, "depth": both & 0xFFFFFF, "rms_mapq": rms, "min_lk": both >> 24, "indel1": None, "indel2": None, "seq1": None, "seq2": None}
            if head >> 4 == SITE:
                yield row | {"kind": "site", "ref": LETTERS[head & 15], "lk": list(stream.take(10))}
                continue
            lk = list(stream.take(3))
            one, two = struct.unpack("<hh", stream.take(4))
            seqs = [stream.take(abs(n)).decode() or None for n in (one, two)]
            yield row | {"kind": "indel", "ref": None, "lk": lk, "indel1": one, "indel2": two, "seq1": seqs[0], "seq2": seqs[1]}


def likelihood_contents(rows: DataFrame, *, parts: int, text: str = "") -> DataFrame:
    """part, content: complete files of ranges of rows (ROWS; kind is site or indel, pos from 1), each under 2 GB; choose parts to fit.

    Reference names come in the order of ``name``; an indel follows the site of its place, or stands at its own.
    """
    order = ["name", "pos", F.col("kind").desc()]
    dealt = rows.repartitionByRange(parts, "name", "pos").sortWithinPartitions(*order).select(*SCHEMA.names, F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def pieces() -> Iterator[bytes]:
            nonlocal part
            yield MAGIC + struct.pack("<i", len(text)) + text.encode()
            name, before = None, 1
            for batch in batches:
                for row in batch.to_pylist():
                    part = row["part"]
                    if row["name"] != name:
                        if name is not None:
                            yield bytes([END << 4])
                        name, before = row["name"], 1
                        yield struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", row["length"])
                    yield packed_record(row, before)
                    before = row["pos"]
            if name is not None:
                yield bytes([END << 4])

        content = binary.packed(pieces())
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([content], pa.binary())], names=["part", "content"])

    return dealt.mapInArrow(run, "part int, content binary")


def unpacked_likelihoods(contents: DataFrame) -> DataFrame:
    """ROWS of files given as rows of content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                some: list[dict] = []
                for row in records_of(content.as_py()):
                    some.append(row)
                    if len(some) == BATCH:
                        yield pa.RecordBatch.from_pylist(some, schema=SCHEMA)
                        some = []
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema=SCHEMA)

    return contents.select("content").mapInArrow(run, ROWS)


def read_likelihoods(spark: SparkSession, path: str) -> DataFrame:
    """ROWS of one file or of all files of a folder."""
    return unpacked_likelihoods(spark.read.format("binaryFile").load(path))
