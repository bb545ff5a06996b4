"""Reads dealt to blocks of places, and reads one by one: the same as from rows of bases, and no base is shuffled."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from cytoframe.operators import calling, pileup
from cytoframe.plans import adapters, catalogue
from cytoframe.functions.columns import parse_cigar

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
CIGARS = ["30M", "4S20M2D7M", "6M3I9M5S", "8M40N9M", "5H3S4M1I2D10M2S3H", "10M2D1D5M"]


@pytest.fixture(scope="module")
def some_reads(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(1, 7), rng.randint(0, 50), rng.randint(0, 9), 900.5 + k, rng.randint(0, 1), rng.randint(1, 12 if k % 3 else 4_000), rng.randint(0, 60), rng.choice([0, 16, 1024]), "T" if k % 3 else "N", rng.choice(CIGARS)) for k in range(900)]
    rows.append(rows[5])  # twice the same read
    return spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, tid int, pos bigint, mapq int, flag int, sample string, cigar string").repartition(3)


def expanded(spark, reads, ops="MS", ends=False):
    return adapters.bases(spark, "", source=reads, ops=ops, keep=[c for c in reads.columns if c != "cigar"], ends=ends)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_bases(df):
    """Whether places of bases come to an exchange or a window."""
    return any(x in plan(df) for x in ("query_at", "sequence(0", "Window"))


def test_draws_equal_those_of_rows(spark, some_reads):
    folded = expanded(spark, some_reads).withColumn("place", F.col("ref_pos") % 1_000)
    columns = {c: F.col(c) for c in ("flag", *adapters.LOOKED_AT)}
    # v6_consensus shuffled every base with its keys
    found = calling.read_base_sums(some_reads, columns, adapters.base_arrays, keys=KEYS, fold=1_000)
    want = {(r.tid, r.place): r for r in calling.base_sums(folded, ["tid", "place"], keys=[*KEYS, "query_at"]).collect()}
    got = {(r.tid, r.place): r for r in found.collect()}
    assert set(got) == set(want) and max(r.n for r in got.values()) == 255
    for k, r in want.items():
        assert list(got[k])[2:] == pytest.approx(list(r)[2:], abs=1e-9), k


def test_mismatch_strings_of_reads(spark, some_reads, data):
    def compared(batch, read, query, place):
        return adapters.base_arrays(batch, read, query)[0], adapters.reference_arrays(batch, read, place)

    rows = expanded(spark, some_reads, "MDN")
    want = sorted(map(tuple, pileup.edit_distances(rows, KEYS).select(*KEYS, "nm", "md").collect()))
    assert sorted(map(tuple, pileup.read_edits(some_reads, KEYS, ["tid"], compared).collect())) == want
    # bases were shuffled, read by read
    assert not shuffles_bases(catalogue.QUERIES["v13_mismatch_strings"][0](spark, data))


@pytest.mark.parametrize("dependent", [True, False])
def test_older_models_of_reads(spark, some_reads, dependent):
    # v5_plain_model made a row of each base, and one of each base's weight
    some = some_reads.where("mapq > 0")
    columns = {c: F.col(c) for c in ("flag", *adapters.LOOKED_AT)} | {"cap": F.col("mapq")}
    rows = expanded(spark, some).where("quality >= 13").withColumn("quality", F.least("quality", "mapq")).withColumn("place", F.col("ref_pos") % 1_000)
    want = {(r.tid, r.place): r for r in calling.older_likelihoods(rows, ["tid", "place"], dependent=dependent).collect()}
    found = calling.older_read_likelihoods(some, columns, adapters.base_arrays, least=13, fold=1_000, dependent=dependent)
    got = {(r.tid, r.place): r for r in found.collect()}
    assert set(got) == set(want) and not shuffles_bases(found)
    for k, r in want.items():
        assert got[k].n == r.n and got[k].likelihoods == pytest.approx(r.likelihoods, abs=1e-6), k


def test_likelihood_records_are_worked_out_once(spark, data):
    # rows were worked out again to find the ranges of files
    found = plan(catalogue.QUERIES["sk19_likelihood_records"][0](spark, data))
    assert "lineitem.parquet" not in found and "query_at" not in found


def test_likelihoods_shuffle_reads_alone(spark, data):
    # F8: v4_genotype_likelihoods shuffled every base of deep sites
    assert not shuffles_bases(catalogue.QUERIES["v4_genotype_likelihoods"][0](spark, data))


def test_depths_of_samples(spark, some_reads):
    rows = expanded(spark, some_reads, "MDNS").where("base is not null").groupBy("tid", F.col("ref_pos").alias("pos"), "sample").agg(F.count("*").alias("depth"))
    want = pileup.sample_columns(rows, sample="sample", samples=["T", "N"], value="depth")
    # j15_sample_depth made a row of each base
    got = pileup.read_depths(some_reads, ["T", "N"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not shuffles_bases(got)


def test_pileup_texts_of_reads(spark, some_reads):
    from cytoframe.operators.intervals import number_rows

    ordered = number_rows(some_reads.where("mapq < 60"), group="tid", at="pos", order=KEYS)
    rows = expanded(spark, ordered, "MDNS", True)
    letters = lambda x, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), x), "")
    ahead = lambda k: adapters.letter(F.col("l_partkey") + (F.col("query_at") + k) * 7 + F.col("l_orderkey"))
    lost = F.substring(letters(lambda k: adapters.letter((F.col("ref_pos") + k) * 7 + F.col("tid")), 9), F.lit(1), F.abs("indel"))
    cell = pileup.pileup_cell(reference=lost, inserted=F.substring(letters(ahead, 9), F.lit(1), F.abs("indel")))
    want = pileup.pileup_strings(rows.withColumn("cell", cell).drop("pos").withColumnRenamed("ref_pos", "pos"), order="ord", cell=F.col("cell"))
    # a26_pileup_text shuffled a row for each base
    got = pileup.read_pileups(some_reads.where("mapq < 60"), adapters.LOOKED_AT, KEYS, adapters.compared_arrays)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not shuffles_bases(got)


def test_rows_of_one_site_are_ranked_together(spark):
    # a30_ranked_alleles gave a row for each, where its SQL gives one
    rows = spark.createDataFrame([(1, 5, "A", 9, 4, 0, 2), (1, 5, "A", 9, 1, 3, 0), (1, 6, "N", 1, 2, 3, 4)], "tid int, pos int, ref string, qsum_a int, qsum_c int, qsum_g int, qsum_t int")
    got = {r.pos: (r.alleles, r.unseen) for r in calling.ranked_alleles(rows, by=["tid", "pos"]).collect()}
    assert got == {5: ("ACCGGTTCCTT", 9), 6: ("NTGCA", -1)}
