"""Compressed binary alignments (BAM): read into rows as the text reader gives them, and encoded again.

A file is one row of Spark's binary reader (2 GB at most, so large alignments come as several files) and is decoded block by block: a task holds
the file and one batch of records. Files are read side by side; nothing is shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.functions import columns as C
from cytoframe.sources.text import header_rows

# --- fixed values: the format's magic numbers, operation and base letters, and number types of tags ---
MAGIC = b"BAM\1"
BLOCK_HEAD = bytes.fromhex("1f8b08040000000000ff0600424302 00".replace(" ", ""))
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPERATIONS = "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}
# --- end of fixed values ---
#: Bytes of a block before it is compressed.
BLOCK = 0xFF00
BATCH = 5_000
_FIXED = struct.Struct("<iiIIiiii")
_PAIRS = [a + b for a in C.NT16 for b in C.NT16]
_CODES = {c: i for i, c in enumerate(C.NT16)}


def unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of the blocks of a compressed file, one after another."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != BLOCK_HEAD[:4]:
            raise ValueError(f"no block begins at byte {at}")
        extra = struct.unpack_from("<H", data, at + 10)[0]
        k, end, size = at + 12, at + 12 + extra, 0
        while k < end:
            kind, n = data[k : k + 2], struct.unpack_from("<H", data, k + 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", data, k + 4)[0] + 1
            k += 4 + n
        if not size or at + size > len(data):
            raise ValueError(f"the block at byte {at} is cut off")
        body = zlib.decompress(data[end : at + size - 8], -15)
        if zlib.crc32(body) != struct.unpack_from("<I", data, at + size - 8)[0]:
            raise ValueError(f"the block at byte {at} is damaged")
        yield body
        at += size


def packed(parts: Iterator[bytes]) -> bytes:
    """A compressed file of the parts, with its end mark."""
    out, rest = [], b""

    def block(body: bytes) -> bytes:
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        inner = pack.compress(body) + pack.flush()
        return BLOCK_HEAD + struct.pack("<H", len(inner) + 25) + inner + struct.pack("<II", zlib.crc32(body), len(body))

    for part in parts:
        rest += part
        while len(rest) >= BLOCK:
            out.append(block(rest[:BLOCK]))
            rest = rest[BLOCK:]
    return b"".join([*out, *([block(rest)] if rest else []), END_BLOCK])


class Stream:
    """Bytes of blocks, taken in pieces of any size."""

    def __init__(self, data: bytes):
        self.blocks, self.held = unpacked(data), b""

    def take(self, n: int) -> bytes:
        some = [self.held]
        have = len(self.held)
        while have < n and (more := next(self.blocks, None)) is not None:
            some.append(more)
            have += len(more)
        whole = b"".join(some)
        if len(whole) < n:
            raise ValueError("the file ends within a record")
        self.held = whole[n:]
        return whole[:n]

    def more(self) -> bool:
        while not self.held and (block := next(self.blocks, None)) is not None:
            self.held = block
        return bool(self.held)

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def header_of(stream: Stream) -> tuple[str, list[tuple[str, int]]]:
    """Header text, and name and length of the targets."""
    if stream.take(4) != MAGIC:
        raise ValueError("not a binary alignment")
    text = stream.take(stream.number()).split(b"\0")[0].decode()
    return text, [(stream.take(stream.number())[:-1].decode(), stream.number()) for _ in range(stream.number())]


def tags_of(data: bytes) -> list[tuple[str, str]]:
    """Tags as name and type:value; whole numbers of any size are i."""
    out, at = [], 0
    while at < len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            code = f"<{n}{NUMBERS[of]}"
            value = ",".join([of, *(f"{x:g}" if of in "fd" else str(x) for x in struct.unpack_from(code, data, at + 5))])
            at += 5 + struct.calcsize(code)
        else:
            x = struct.unpack_from("<" + NUMBERS[kind], data, at)[0]
            value, at = (f"{x:g}" if kind in "fd" else str(x)), at + struct.calcsize(NUMBERS[kind])
            kind = kind if kind in "fd" else "i"
        out.append((name, f"{kind}:{value}"))
    return out


def tag_bytes(name: str, value: str) -> bytes:
    kind, _, text = value.partition(":")
    head = name.encode() + kind.encode()
    if kind in "ZH":
        return head + text.encode() + b"\0"
    if kind == "A":
        return head + text.encode()
    if kind == "B":
        of, *numbers = text.split(",")
        return head + of.encode() + struct.pack("<i", len(numbers)) + struct.pack(f"<{len(numbers)}{NUMBERS[of]}", *(float(x) if of in "fd" else int(x) for x in numbers))
    return head + struct.pack("<" + NUMBERS[kind], float(text) if kind in "fd" else int(text))


FIELDS = pa.schema([
    ("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_rname", pa.string()), ("mpos", pa.int64()),
    ("isize", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("aux", pa.map_(pa.string(), pa.string())),
])
_SCHEMA = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, mate_rname string, mpos bigint, isize bigint, seq string, qual string, aux map<string,string>"


def record(data: bytes, names: list[str]) -> tuple:
    """One record's fields in the order of FIELDS."""
    tid, pos, low, high, n_seq, mtid, mpos, isize = _FIXED.unpack_from(data)
    n_name, n_ops, flag = low & 0xFF, high & 0xFFFF, high >> 16
    at = _FIXED.size + n_name
    name = data[_FIXED.size : at - 1].decode()
    ops = np.frombuffer(data, "<u4", n_ops, at)
    at += 4 * n_ops
    letters = "".join(map(_PAIRS.__getitem__, data[at : at + (n_seq + 1) // 2]))[:n_seq]
    at += (n_seq + 1) // 2
    quality = data[at : at + n_seq]
    target = lambda t: names[t] if 0 <= t < len(names) else None
    return (
        name, flag, target(tid), pos + 1 if pos >= 0 else None, low >> 8 & 0xFF, "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops.tolist()) or "*", target(mtid), mpos + 1 if mpos >= 0 else None,
        isize, letters or None, None if not quality or quality[0] == 0xFF else bytes(min(q, 93) + 33 for q in quality).decode(), tags_of(data[at + n_seq :]),
    )


def record_bytes(row: dict, targets: dict[str, int]) -> bytes:
    """One record, length first, of a row of FIELDS."""
    ops = [int(n) << 4 | OPERATIONS.index(c) for n, c in _operations(row["cigar"])]
    seq, name = row["seq"] or "", row["qname"].encode() + b"\0"
    codes = [_CODES.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    quality = bytes(ord(c) - 33 for c in row["qual"]) if row["qual"] else b"\xff" * len(seq)
    at = (row["pos"] or 0) - 1
    length = sum(x >> 4 for x in ops if OPERATIONS[x & 15] in "MDN=X") or 1
    place = lambda c: targets.get(row[c], -1) if row[c] is not None else -1
    fixed = _FIXED.pack(place("rname"), at, _bin(at, at + length) << 16 | (row["mapq"] or 0) << 8 | len(name), (row["flag"] or 0) << 16 | len(ops), len(seq), place("mate_rname"), (row["mpos"] or 0) - 1, row["isize"] or 0)
    body = fixed + name + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + quality + b"".join(tag_bytes(k, v) for k, v in sorted(dict(row["aux"] or ()).items()))
    return struct.pack("<i", len(body)) + body


def _operations(cigar: str | None) -> list[tuple[str, str]]:
    import re

    return re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")


def _bin(begin: int, end: int) -> int:
    """The smallest bin of the hierarchical scheme that holds [begin, end)."""
    begin, end = max(begin, 0), max(end, 1) - 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Rows as ``read_sam`` gives them, of one file or of all files of a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                stream = Stream(content.as_py())
                names = [n for n, _ in header_of(stream)[1]]
                rows: list[tuple] = []
                while stream.more():
                    rows.append(record(stream.take(stream.number()), names))
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    rows = _files(spark, path).mapInArrow(run, _SCHEMA)
    cigar = C.parse_cigar(F.col("cigar"))
    unmapped = (F.size(cigar) == 0) & (F.col("flag").bitwiseAND(4) == 0)
    return rows.withColumn("flag", F.when(unmapped, F.col("flag").bitwiseOR(4)).otherwise(F.col("flag"))).withColumn("cigar", cigar)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows), FIELDS)], schema=FIELDS)


def read_bam_header(spark: SparkSession, path: str) -> DataFrame:
    """Header rows as ``read_header`` gives them; targets that the text doesn't name get a row of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                text, targets = header_of(Stream(content.as_py()))
                lines = [x for x in text.split("\n") if x]
                known = {t[3:] for x in lines if x.startswith("@SQ") for t in x.split("\t") if t.startswith("SN:")}
                lines += [f"@SQ\tSN:{n}\tLN:{size}" for n, size in targets if n not in known]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return header_rows(_files(spark, path).mapInArrow(run, "value string"))


def bam_contents(reads: DataFrame, header: DataFrame, *, order: list[str | Column], parts: int) -> DataFrame:
    """part, content: complete binary files of ranges of the reads in order (each under 2 GB; choose parts to fit).

    reads: rows as ``read_sam`` gives them; header: as ``read_header``. The header's lines, a few hundred, go to every task.
    """
    from cytoframe.sources.text import header_lines, header_targets

    text = "".join(r.value + "\n" for r in header_lines(header).collect())
    targets = [(r.name, r.length) for r in header_targets(header).orderBy("tid").collect()]
    number = {n: i for i, (n, _) in enumerate(targets)}
    head = MAGIC + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(targets)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size or 0) for n, size in targets)
    rows = reads.withColumn("cigar", C.format_cigar(F.col("cigar"))).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*FIELDS.names).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def pieces() -> Iterator[bytes]:
            nonlocal part
            yield head
            for batch in batches:
                for row in batch.to_pylist():
                    part = row["part"]
                    yield record_bytes(row, number)

        content = packed(pieces())
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([content], pa.binary())], names=["part", "content"])

    return rows.mapInArrow(run, "part int, content binary")
