"""Compressed binary alignments (BAM) as a data source that many tasks read at once.

A file's bytes are dealt out in ranges. A task looks for the first block that begins in its range (a block head whose block is followed by another one, or by the file's
end), then for the first record in what that block unpacks to (a chain of records whose fields agree with each other), and reads all records that begin in its
blocks, the last one on into the blocks after them. So every record is read by one task, wherever ranges cut. The header, which names the chromosomes, is read by each task.

Files are opened by pyarrow's file systems, so paths may be local or of any store that these reach. Filters on rname, pos, flag and mapq are tested before a record's
letters and tags are decoded (with ``spark.sql.python.filterPushdown.enabled``), and by Spark again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from cytoframe.functions import columns as C
from cytoframe.sources import binary

SPLIT = 64 << 20
#: Most bytes of a block, and records that must follow each other for a place to begin one.
MOST_BLOCK = 1 << 16
CHAIN = 12
#: Most bytes of a record that is taken for one.
MOST_RECORD = 1 << 28
BATCH = 5_000


@dataclass
class Range(InputPartition):
    """Bytes of a file whose blocks' records a task reads."""

    path: str
    begin: int
    end: int


class Blocks:
    """A file's blocks from some place on; at: where the block that was given last begins."""

    def __init__(self, path: str):
        system, name = _opened(path)
        self.file, self.size = system.open_input_file(name), system.get_file_info(name).size
        self.at = self.next = 0

    def head(self, at: int) -> int:
        """Bytes of the block that begins at a place, 0 where none does."""
        data = self.file.read_at(18, at) if at < self.size else b""
        if len(data) < 18 or data[:4] != binary.BLOCK_HEAD[:4]:
            return 0
        extra, k = struct.unpack_from("<H", data, 10)[0], 12
        if data[12:14] != b"BC":
            data = self.file.read_at(12 + extra, at)
            while k + 4 <= len(data) and data[k : k + 2] != b"BC":
                k += 4 + struct.unpack_from("<H", data, k + 2)[0]
        return struct.unpack_from("<H", data, k + 4)[0] + 1 if k + 6 <= len(data) else 0

    def seek(self, at: int, end: int) -> bool:
        """Goes to the first block that begins in [at, end); False where there is none."""
        while at < min(end, self.size):
            data = self.file.read_at(min(MOST_BLOCK, self.size - at) + 4, at)
            k = data.find(binary.BLOCK_HEAD[:4])
            if k < 0:
                at += max(len(data) - 3, 1)
                continue
            size = self.head(at + k)
            if size and (at + k + size == self.size or self.head(at + k + size)) and at + k < end:
                self.next = at + k
                return True
            at += k + 1
        return False

    def take(self) -> bytes | None:
        """What the next block unpacks to, None at the end."""
        if self.next >= self.size:
            return None
        self.at, size = self.next, self.head(self.next)
        if not size or self.at + size > self.size:
            raise ValueError(f"no whole block begins at byte {self.at}")
        data = self.file.read_at(size, self.at)
        self.next = self.at + size
        begin = 12 + struct.unpack_from("<H", data, 10)[0]
        body = zlib.decompress(data[begin : size - 8], -15)
        if zlib.crc32(body) != struct.unpack_from("<I", data, size - 8)[0]:
            raise ValueError(f"the block at byte {self.at} is damaged")
        return body


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files of a folder whose names don't begin with _ or a dot."""
    system, name = _opened(path)
    info = system.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    return sorted((head + x.path, x.size) for x in system.get_file_info(pafs.FileSelector(name)) if x.type == pafs.FileType.File and x.base_name[0] not in "_.")


class Records:
    """Records of a file, with the block that each begins in. What is held begins at ``gone``; places are counted from there."""

    def __init__(self, path: str):
        self.blocks = Blocks(path)
        self.clear()

    def clear(self) -> None:
        self.held, self.gone = b"", 0
        self.pieces: list[tuple[int, int]] = []  # (where a block's bytes end in what is held, place of the block)

    def left(self) -> int:
        return len(self.held) - self.gone

    def fill(self, n: int) -> bool:
        """Whether so many bytes are held, after reading on."""
        while len(self.held) - self.gone < n:
            body = self.blocks.take()
            if body is None:
                return False
            if body:
                self.pieces = [(upto - self.gone, at) for upto, at in self.pieces if upto > self.gone]
                self.held, self.gone = self.held[self.gone :] + body, 0
                self.pieces.append((len(self.held), self.blocks.at))
        return True

    def block(self, at: int = 0) -> int:
        """Place of the block that holds a byte."""
        return next(place for upto, place in self.pieces if upto > self.gone + at)

    def get(self, at: int, n: int) -> bytes:
        return self.held[self.gone + at : self.gone + at + n]

    def number(self, at: int) -> int:
        return struct.unpack_from("<i", self.held, self.gone + at)[0]

    def header(self) -> list[str]:
        """Names of the targets; goes on to the first record."""
        self.fill(8)
        if self.get(0, 4) != binary.MAGIC:
            raise ValueError("not a binary alignment")
        at = 8 + self.number(4)
        self.fill(at + 4)
        names, n = [], self.number(at)
        at += 4
        for _ in range(n):
            self.fill(at + 4)
            size = self.number(at)
            self.fill(at + 8 + size)
            names.append(self.get(at + 4, size - 1).decode())
            at += 8 + size
        self.gone += at
        return names

    def plausible(self, at: int, targets: int) -> int:
        """Bytes of the record that may begin at a place, 0 where none can."""
        if not self.fill(at + 36):
            return 0
        size, tid, pos, low, high, n_seq, mtid, mpos = struct.unpack_from("<iiiIIiii", self.held, self.gone + at)
        n_name, n_ops = low & 0xFF, high & 0xFFFF
        fits = 32 <= size <= MOST_RECORD and -1 <= tid < targets and -1 <= mtid < targets and pos >= -1 and mpos >= -1 and n_seq >= 0 and n_name > 0
        if not fits or 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq > size or not self.fill(at + 36 + n_name):
            return 0
        name = self.get(at + 36, n_name)
        return size + 4 if name[-1] == 0 and all(32 < c < 127 for c in name[:-1]) else 0

    def find(self, targets: int, end: int) -> bool:
        """Goes to the first record that begins in what follows, as long as its block begins before end."""
        at = 0
        while self.fill(at + 1) and self.block(at) < end:
            k, chained = at, 0
            while chained < CHAIN and (size := self.plausible(k, targets)):
                k, chained = k + size, chained + 1
                if not self.fill(k + 1):
                    # the file ends: with the record, if it is one
                    chained = CHAIN if self.left() == k else 0
                    break
            if chained == CHAIN:
                self.gone += at
                return True
            at += 1
        return False


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))
        self.tests: list[Filter] = []

    def partitions(self) -> list[Range]:
        return [Range(path, at, min(at + self.split, size)) for path, size in _files(self.path) for at in range(0, size, self.split)] or [Range("", 0, 0)]

    def passes(self, values: dict) -> bool:
        for f in self.tests:
            x, y = values[f.attribute[0]], f.value
            if x is None or not {"EqualTo": x == y, "GreaterThan": y is not None and x > y, "GreaterThanOrEqual": y is not None and x >= y, "LessThan": y is not None and x < y, "LessThanOrEqual": y is not None and x <= y}[type(f).__name__]:
                return False
        return True

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.begin == part.end:
            return
        records = Records(part.path)
        names = records.header()
        if part.begin:
            records.clear()
            if not records.blocks.seek(part.begin, part.end) or not records.find(len(names), part.end):
                return
        rows = []
        while records.fill(1):
            if not records.fill(4):
                raise ValueError("the file ends within a record")
            if records.block() >= part.end:
                break
            size = records.number(0)
            if not records.fill(4 + size):
                raise ValueError("the file ends within a record")
            body = records.get(4, size)
            records.gone += 4 + size
            if self.tests:
                tid, pos, low, high = struct.unpack_from("<iiII", body)
                if not self.passes({"rname": names[tid] if 0 <= tid < len(names) else None, "pos": pos + 1 if pos >= 0 else None, "mapq": low >> 8 & 0xFF, "flag": high >> 16}):
                    continue
            rows.append(binary.record(body, names))
            if len(rows) == BATCH:
                yield binary._batch(rows)
                rows = []
        if rows:
            yield binary._batch(rows)


class FilteringBamReader(BamReader):
    """A reader that Spark tells its filters; only for sessions that have this switched on, as Spark refuses it otherwise."""

    def pushFilters(self, filters: list[Filter]):
        kinds = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        self.tests = [f for f in filters if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in ("rname", "pos", "flag", "mapq")]
        return filters  # Spark tests them again


class BamSource(DataSource):
    """``spark.read.format("bam")`` of a file or folder; options splitBytes: bytes of a task's range, filters: true where the session pushes filters into such sources."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return binary._SCHEMA

    def reader(self, schema) -> BamReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringBamReader if options.get("filters", "").lower() == "true" else BamReader)(options)


def read_bam_ranges(spark: SparkSession, path: str, *, split_bytes: int = SPLIT) -> DataFrame:
    """Rows as ``read_bam`` gives them; ranges of a file are read by tasks of their own."""
    spark.dataSource.register(BamSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    rows = spark.read.format("bam").option("splitBytes", split_bytes).option("filters", pushes).load(path)
    cigar = C.parse_cigar(F.col("cigar"))
    unmapped = (F.size(cigar) == 0) & (F.col("flag").bitwiseAND(4) == 0)
    return rows.withColumn("flag", F.when(unmapped, F.col("flag").bitwiseOR(4)).otherwise(F.col("flag"))).withColumn("cigar", cigar)


def has_end_mark(path: str) -> bool:
    """Whether a file ends with the empty block that closes whole files."""
    system, name = _opened(path)
    size = system.get_file_info(name).size
    with system.open_input_file(name) as f:
        return size >= len(binary.END_BLOCK) and f.read_at(len(binary.END_BLOCK), size - len(binary.END_BLOCK)) == binary.END_BLOCK
