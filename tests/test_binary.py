"""Binary alignments: encoded from rows, decoded again, and against a file put together by hand."""

import struct
import zlib

import pytest

from cytoframe.sources import binary, text

HEADER = "@HD\tVN:1.4\tSO:coordinate\n@SQ\tSN:chr1\tLN:5000\n@SQ\tSN:chr2\tLN:800\n@RG\tID:g1\tSM:s\tLB:l\n"
LINES = [
    "r1\t99\tchr1\t100\t60\t4M1I3M\t=\t200\t108\tACGTNACG\tIIIIIIII\tRG:Z:g1\tNM:i:2\tXA:A:c",
    "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*\tXF:f:1.5",
    "r3\t16\tchr2\t7\t255\t2S3M2D2M\tchr1\t100\t0\tACGTACG\t!5IIII~\tXB:B:s,1,-2,300",
]


def test_round_trip(spark, tmp_path):
    (tmp_path / "a.sam").write_text(HEADER + "\n".join(LINES) + "\n")
    reads, header = text.read_sam(spark, f"{tmp_path}/a.sam"), text.read_header(spark, f"{tmp_path}/a.sam")
    rows = binary.bam_contents(reads, header, order=["qname"], parts=2).collect()
    (tmp_path / "bam").mkdir()
    for r in rows:
        (tmp_path / "bam" / f"{r.part}.bam").write_bytes(r.content)
    again = binary.read_bam(spark, f"{tmp_path}/bam")
    assert again.columns == reads.columns
    lines = lambda df: sorted(r.value for r in text.sam_lines(df).collect())
    assert lines(again) == lines(reads)
    found = binary.read_bam_header(spark, f"{tmp_path}/bam/{rows[0].part}.bam")
    assert "".join(r.value + "\n" for r in text.header_lines(found).collect()) == HEADER
    assert binary.bam_contents(reads.limit(0), header, order=["qname"], parts=2).count() == 0


def test_file_by_hand():
    body = binary.MAGIC + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 50)
    one = struct.pack("<iiIIiiii", 0, 9, 4681 << 16 | 7 << 8 | 2, 16 << 16 | 1, 3, -1, -1, 0) + b"q\0" + struct.pack("<I", 3 << 4) + bytes([0x12, 0x40]) + bytes([30, 31, 32])
    stream = binary.Stream(binary.packed(iter([body, struct.pack("<i", len(one)) + one])))
    assert binary.header_of(stream) == ("", [("c1", 50)])
    assert binary.record(stream.take(stream.number()), ["c1"]) == ("q", 16, "c1", 10, 7, "3M", None, None, 0, "ACG", "?@A", [])
    assert not stream.more()


def test_long_and_damaged_files():
    data = bytes(range(256)) * 1_000
    whole = binary.packed(iter([data[:70_000], data[70_000:]]))
    assert b"".join(binary.unpacked(whole)) == data and whole.endswith(binary.END_BLOCK)
    assert zlib.decompress(whole[18 : struct.unpack_from("<H", whole, 16)[0] - 7], -15) == data[: binary.BLOCK]
    with pytest.raises(ValueError, match="damaged|invalid|cut off"):
        list(binary.unpacked(whole[:100] + b"\0" + whole[101:5_000]))
    with pytest.raises(ValueError, match="no block"):
        list(binary.unpacked(b"plain text that is no block"))
    with pytest.raises(ValueError, match="ends within"):
        binary.Stream(binary.packed(iter([b"ab"]))).take(3)
