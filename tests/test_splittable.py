"""Binary alignments in ranges: the same rows wherever ranges cut, filters on place, whole and cut files."""

import random

import pytest
from pyspark.sql import functions as F

from cytoframe.sources import binary, splittable


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(3)
    targets = {"chr1": 0, "chr2": 1, "chrX": 2}
    rows = []
    for k in range(1_200):
        n = rng.choice([0, 1, 30, 75, 400])
        placed = rng.random() < 0.9
        rows.append({
            "qname": f"r{k}", "flag": rng.choice([0, 16, 99]) if placed else 4, "rname": rng.choice([*targets]) if placed else None, "pos": rng.randint(1, 10**6) if placed else None, "mapq": rng.randint(0, 60), "cigar": f"{n}M" if placed and n else "*",
            "mate_rname": None, "mpos": None, "isize": 0, "seq": "".join(rng.choice("ACGTN") for _ in range(n)) or None, "qual": "".join(chr(33 + rng.randint(0, 60)) for _ in range(n)) or None, "aux": {"NM": "i:3", "ZZ": "Z:" + "x" * rng.choice([0, 5, 3_000] if k % 50 == 0 else [0, 5])},
        })
    import struct

    text = "@HD\tVN:1.4\n"
    head = binary.MAGIC + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", 3) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 10**6) for n in targets)
    return head, [binary.record_bytes(r, targets) for r in rows]


def wrote(path, contents, block, monkeypatch):
    monkeypatch.setattr(binary, "BLOCK", block)
    path.write_bytes(binary.packed(iter([contents[0], *contents[1]])))
    return str(path)


def rows_of(reader, part):
    return [tuple(r.values()) for b in reader.read(part) for r in b.to_pylist()]


@pytest.mark.parametrize("block", [300, 5_000, 0xFF00])
def test_any_cut_gives_the_same_rows(tmp_path, contents, block, monkeypatch):
    path = wrote(tmp_path / "a.bam", contents, block, monkeypatch)
    reader, size = splittable.BamReader({"path": path}), (tmp_path / "a.bam").stat().st_size
    every = rows_of(reader, splittable.Range(path, 0, size))
    assert len(every) == 1_200 and [r[0] for r in every] == [f"r{k}" for k in range(1_200)]
    blocks, begins = splittable.Blocks(path), []
    while blocks.take() is not None:
        begins.append(blocks.at)
    # at every block, one byte before and after it
    for at in begins if block > 300 else begins[:: max(1, len(begins) // 25)]:
        for cut in (at - 1, at, at + 1):
            if 0 < cut < size:
                assert rows_of(reader, splittable.Range(path, 0, cut)) + rows_of(reader, splittable.Range(path, cut, size)) == every
    parts = splittable.BamReader({"path": path, "splitbytes": "3000"}).partitions()
    assert [r for p in parts for r in rows_of(reader, p)] == every and len(parts) > 3


def test_spark_reads_ranges_side_by_side(spark, tmp_path, contents, monkeypatch):
    (tmp_path / "bams").mkdir()
    for name in ("a.bam", "b.bam"):
        wrote(tmp_path / "bams" / name, contents, 4_000, monkeypatch)
    whole = binary.read_bam(spark, f"{tmp_path}/bams")
    ranges = splittable.read_bam_ranges(spark, f"{tmp_path}/bams", split_bytes=20_000)
    assert ranges.rdd.getNumPartitions() > 8 and ranges.columns == whole.columns
    shown = lambda df: sorted(str(r) for r in df.withColumn("aux", F.array_sort(F.map_entries("aux"))).collect())
    assert shown(ranges) == shown(whole)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = lambda df: shown(df.where("rname = 'chr2' and pos >= 1000 and pos < 500000 and mapq > 20"))
        assert some(splittable.read_bam_ranges(spark, f"{tmp_path}/bams", split_bytes=20_000)) == some(whole)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_spare_records(tmp_path, contents, monkeypatch):
    path = wrote(tmp_path / "a.bam", contents, 4_000, monkeypatch)
    reader = splittable.FilteringBamReader({"path": path})
    filters = [splittable.EqualTo(("rname",), "chr1"), splittable.LessThan(("pos",), 1_000), splittable.EqualTo(("qname",), "r1")]
    assert list(reader.pushFilters(filters)) == filters and len(reader.tests) == 2
    got = rows_of(reader, splittable.Range(path, 0, 10**9))
    assert all(r[2] == "chr1" and r[3] < 1_000 for r in got) and len(got) < 20


def test_cut_damaged_and_empty_files(tmp_path, contents, monkeypatch):
    path = wrote(tmp_path / "a.bam", contents, 4_000, monkeypatch)
    data = (tmp_path / "a.bam").read_bytes()
    assert splittable.has_end_mark(path)
    cut = tmp_path / "cut.bam"
    cut.write_bytes(data[: len(data) // 2])
    assert not splittable.has_end_mark(str(cut))
    reader = splittable.BamReader({"path": str(cut)})
    with pytest.raises(ValueError, match="no whole block|ends within"):
        rows_of(reader, splittable.Range(str(cut), 0, len(data)))
    (tmp_path / "none.bam").write_bytes(binary.packed(iter([contents[0]])))
    empty = splittable.BamReader({"path": str(tmp_path / "none.bam")})
    assert [r for p in empty.partitions() for r in rows_of(empty, p)] == []
    with pytest.raises(FileNotFoundError):
        splittable.BamReader({"path": str(tmp_path / "gone.bam")}).partitions()
