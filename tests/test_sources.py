"""Readers and writers over small files made here."""

import pytest
from pyspark.sql import functions as F

from cytoframe.sources import text as S

HEADER = "@HD\tVN:1.0\tSO:coordinate\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\n@RG\tID:a\tSM:s\tLB:l\n@CO\tfree text\n"
READS = (
    "r1\t99\tchr1\t10\t60\t5S10M2D3=1X\t=\t50\t44\tACGTACGTACGTACGTACG\t*\tRG:Z:a\tNM:i:2\n"
    "r2\t0x10\tchr2\t5\t0\t*\t*\t0\t0\t*\t*\n"
    "r3\tpP\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"
)


@pytest.fixture
def sam(tmp_path):
    p = tmp_path / "a.sam"
    p.write_text(HEADER + READS)
    return str(p)


def test_sam_round_trip(spark, sam, tmp_path):
    rows = S.read_sam(spark, sam)
    got = {r.qname: r for r in rows.collect()}
    assert got["r1"].cigar[2].op == "D" and [x.op for x in got["r1"].cigar][-1] == "M" and got["r1"].aux == {"RG": "Z:a", "NM": "i:2"}
    assert got["r2"].flag == 0x10 | 4 and got["r3"].flag == 3 | 4 and got["r3"].rname is None
    assert got["r1"].mate_rname == "chr1" and got["r2"].pos == 5 and got["r3"].pos is None
    out = str(tmp_path / "out")
    S.sam_lines(rows).write.text(out)
    again = {r.qname: r for r in S.read_sam(spark, out).collect()}
    assert again == got


def test_header(spark, sam, tmp_path):
    h = S.read_header(spark, sam)
    assert [tuple(r) for r in S.header_targets(h).orderBy("tid").collect()] == [(0, "chr1", 1000), (1, "chr2", 500)]
    assert [tuple(r)[:3] for r in S.header_groups(h).collect()] == [("a", "l", "s")]
    assert S.header_faults(h).count() == 0
    assert [r.value for r in S.header_lines(h).collect()] == HEADER.strip().split("\n")
    bad = tmp_path / "bad.sam"
    bad.write_text("@SQ\tSN:x\n@SQ\tSN:x\tLN:3\n@ZZ\tAB:1\n@RG\tXX:1\tID:q\n")
    faults = {(r.kind, r.fault) for r in S.header_faults(S.read_header(spark, str(bad))).collect()}
    assert faults == {("SQ", "no LN"), ("SQ", "repeats x"), ("ZZ", "unknown type"), ("RG", "unknown XX")}
    merged = {(r.kind, r.name): (r.tags, r.conflict) for r in S.merge_headers(h, S.read_header(spark, str(bad))).collect()}
    assert merged["SQ", "chr1"] == ({"SN": "chr1", "LN": "1000"}, False) and ("RG", "q") in merged


def test_variants(spark, tmp_path):
    p = tmp_path / "a.vcf"
    p.write_text("##x\nchr1\t5\tid\tA\tC\t50\tPASS\tDP=30;AF=1.2;AF_N=0.1;TG=x\nchr1\t6\t.\tA\tAC\t.\tPASS\tDB;AF=0.2\nchrX\t7\t.\tA\tC\t9\tPASS\tAF=0.2\nchr2\t8\t.\tA\tC\t9\tlow\tAF=bad\n")
    rows = S.read_vcf(spark, str(p)).collect()
    assert [(r.chromosome, r.pos, r.dp, r.af, r.af_n, r.tg, r.dp_n) for r in rows] == [("chr1", 5, 30, 1.0, 0.1, "x", None)]
    every = {r.pos: r for r in S.read_vcf(spark, str(p), passing=False).collect()}
    assert every[6].db and every[8].af is None


def test_lists(spark, tmp_path):
    p = tmp_path / "parts"
    p.write_text("chr1 1 100 a\n\n  chr2\t5 50 b\n")
    assert [tuple(r) for r in S.read_partitions(spark, str(p)).orderBy("chromosome").collect()] == [("chr1", 1, 100, "a"), ("chr2", 5, 50, "b")]
    p = tmp_path / "sv"
    p.write_text("#h\n1\t5\nchr2\t6\tx\n")
    assert [tuple(r) for r in S.read_breakpoints(spark, str(p)).orderBy("pos").collect()] == [("chr1", 5), ("chr2", 6)]
    p = tmp_path / "sites"
    p.write_text("chr1 7 +1 -2\n#x\nchr1 9\n")
    assert [tuple(r) for r in S.read_sites(spark, str(p)).orderBy("pos").collect()] == [("chr1", 7, [1, -2]), ("chr1", 9, [])]
    p = tmp_path / "names"
    p.write_text("chr2 chr1\nchrX\n")
    assert [tuple(r) for r in S.read_names(spark, str(p)).orderBy("ord").collect()] == [(0, "chr2"), (1, "chr1"), (2, "chrX")]
    p = tmp_path / "snps"
    p.write_text("rs1 0 55 A G\n")
    assert [tuple(r) for r in S.read_known_snps(spark, str(p)).collect()] == [("rs1", 55, "A", "G")]


def test_two_dialects_give_the_same_rows(spark, tmp_path):
    a, b, c = tmp_path / "a", tmp_path / "b", tmp_path / "c"
    a.write_text("#Any 1.1\nchromosome\tstart\tend\trcount_t\trcount_n\tGC\nchr1\t1\t10\t5\t6\t0.4\nchr1\t11\t20\t7\t8\t-1\n")
    b.write_text("#SOME_VERSION=1.0\nx\tchr\ts\te\ty\ty\ty\tt\tn\tgc\n0\tchr1\t1\t10\t9\t9\t9\t5\t6\t0.4\n1\tchr1\t11\t20\t9\t9\t9\t7\t8\t-1\n")
    c.write_text("nothing\n")
    rows = lambda p: [tuple(r) for r in S.read_counts(spark, str(p)).orderBy("p_start").collect()]
    assert rows(a) == rows(b) == [("chr1", 1, 10, 5, 6, 0.4), ("chr1", 11, 20, 7, 8, None)]
    with pytest.raises(ValueError):
        S.read_counts(spark, str(c))
    a.write_text("#Any 1.1\nh\n3\tchr1\t55\t1\t2\t3\t4\t5\t6\t7\t8\t0\t2\n")
    r = S.read_snp_counts(spark, str(a)).collect()[0]
    assert (r.part_no, r.chromosome, r.pos, r.t, r.n, r.allele_a, r.allele_b) == (3, "chr1", 55, [1, 2, 3, 4], [5, 6, 7, 8], 0, 2)


def test_tsv_and_mutation_ids(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1.23456789), (1, None)], "k int, x double")
    S.write_tsv(rows, str(tmp_path / "o"), order=["k"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).collect() if r.value != "k\tx"]
    assert sorted(lines) == ["1\t-1.0", "2\t1.23457"]
    ids = spark.createDataFrame([("A", "C"), ("AT", "A"), ("A", "AT"), ("AT", "CG")], "r string, a string").select(S.mutation_id(F.lit("m"), F.col("r"), F.col("a")).alias("i"))
    assert [r.i for r in ids.collect()] == ["m_SNM", "m_DEL", "m_INS", None]
