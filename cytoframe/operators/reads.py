"""Alignment rows: filters, counts, sorting, duplicates and mates.

Rows have tid, pos (1-based), flag, mapq, mtid, isize, qname and, where named, cigar, rg, qual sums. A total order
must be given wherever a result depends on order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoframe.functions.columns import FLAGS, PILEUP_MASK, has_bits, has_none, natural_key

#: End of a region that names none.
REGION_END = 1 << 29


def view_filter(reads: DataFrame, *, min_mapq: int = 0, required: int = 0, excluded: int = 0) -> DataFrame:
    """Reads of enough mapping quality with all required and no excluded flag bits."""
    return reads.where((F.col("mapq") >= min_mapq) & has_bits(F.col("flag"), required) & has_none(F.col("flag"), excluded))


def read_group_filter(reads: DataFrame, groups: set[str] | None, library: str | None, libraries: DataFrame | None = None) -> DataFrame:
    """By read group, else by library.

    A read with a group passes or fails by the set of groups, if one is given; only reads without a group, or with no
    set given, come to the library test, which fails reads whose library isn't known. libraries: rg, lb.
    """
    member = F.col("rg").isin(*groups) if groups else F.lit(None).cast("boolean")
    if library is None:
        return reads.where(F.coalesce(member, F.lit(True)))
    known = reads.join(libraries, "rg", "left")
    return known.where(F.coalesce(member, F.coalesce(F.col("lb") == library, F.lit(False)))).drop("lb")


def parse_region(text: str) -> tuple[str, int, int]:
    """chr[:from[-to]] with commas and blanks ignored -> name, zero-based begin, end."""
    bare = re.sub(r"[,\s]", "", text)
    name, colon, rest = bare.rpartition(":")
    if not colon or not re.fullmatch(r"\d+(-\d*)?", rest):
        return bare, 0, REGION_END
    first, dash, last = rest.partition("-")
    return name, max(0, int(first) - 1), int(last) if last else REGION_END


def region_filter(reads: DataFrame, tid: int, begin: int, end: int) -> DataFrame:
    """Reads that overlap [begin, end), zero-based; pos is 1-based, ref_end the last reference base."""
    return reads.where((F.col("tid") == tid) & (F.col("pos") - 1 < end) & (F.col("ref_end") > begin))


def pileup_filter(reads: DataFrame, mask: int = PILEUP_MASK) -> DataFrame:
    """Reads without the bits of mask; unmapped reads never pass."""
    return reads.where(has_none(F.col("flag"), mask | FLAGS["UNMAP"]))


def multi_pileup_keep(flag: Column, mapq: Column, *, min_mapq: int = 0, cap: Column | None = None, orphans: bool = False) -> Column:
    """The read tests of a multi-sample pileup, in order: with a cap, only the cap decides (negative drops)."""
    if cap is not None:
        return cap >= 0
    keep = has_none(flag, FLAGS["UNMAP"]) & (mapq >= min_mapq)
    return keep if orphans else keep & ~(has_bits(flag, FLAGS["PAIRED"]) & has_none(flag, FLAGS["PROPER"]))


def clip_mapq(mapq: Column, cigar: Column) -> Column:
    """Mapping quality, 0 for reads with hard clips or padding."""
    return F.when(F.exists(cigar, lambda x: x["op"].isin("H", "P")), 0).otherwise(mapq)


def flag_statistics(reads: DataFrame) -> DataFrame:
    """One row of counts over all reads; those of pairs only over paired, mapped ones."""
    flag = F.col("flag")
    paired, mapped = has_bits(flag, 1), has_none(flag, 4)
    both = paired & mapped & has_none(flag, 8)
    apart = both & (F.col("mtid") != F.col("tid"))
    counts = {
        "n_reads": F.lit(True),
        "n_qcfail": has_bits(flag, 512),
        "n_dup": has_bits(flag, 1024),
        "n_mapped": mapped,
        "n_paired": paired,
        "n_proper": paired & has_bits(flag, 2),
        "n_read1": paired & has_bits(flag, 64),
        "n_read2": paired & has_bits(flag, 128),
        "n_single": paired & mapped & has_bits(flag, 8),
        "n_both_mapped": both,
        "n_diff_chr": apart,
        "n_diff_high": apart & (F.col("mapq") >= 5),
    }
    return reads.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])


def index_statistics(reads: DataFrame, targets: DataFrame) -> DataFrame:
    """tid, mapped and unmapped reads for each target, and a row with tid -1 for reads without a place."""
    counts = reads.groupBy(F.coalesce("tid", F.lit(-1)).alias("tid")).agg(F.count_if(has_none(F.col("flag"), 4)).alias("n_mapped"), F.count_if(has_bits(F.col("flag"), 4)).alias("n_unmapped"))
    every = targets.select("tid").unionByName(targets.sparkSession.createDataFrame([(-1,)], "tid int").select(F.col("tid").cast(targets.schema["tid"].dataType)))
    return every.join(counts, "tid", "left").select("tid", F.coalesce("n_mapped", F.lit(0)).alias("n_mapped"), F.coalesce("n_unmapped", F.lit(0)).alias("n_unmapped"))


def sort_reads(reads: DataFrame, *, by: str = "position", ties: list[str]) -> DataFrame:
    """Ordered by (tid, pos), reads without a place last, or by name with digits by value, then place."""
    place = [(F.col("tid") < 0) | F.col("tid").isNull(), F.col("tid"), F.col("pos")]
    keys = place if by == "position" else [natural_key(F.col("qname")), *place]
    return reads.orderBy(*keys, *ties)


def merge_sorted(inputs: list[DataFrame], *, names: list[str] | None = None, ties: list[str]) -> DataFrame:
    """All inputs in order of (tid, pos, strand), then of input. names: read groups set for the inputs."""
    out = None
    for i, df in enumerate(inputs):
        df = df.withColumn("source_no", F.lit(i))
        if names:
            df = df.withColumn("rg", F.lit(names[i]))
        out = df if out is None else out.unionByName(df)
    return out.orderBy((F.col("tid") < 0) | F.col("tid").isNull(), "tid", "pos", has_bits(F.col("flag"), FLAGS["REVERSE"]), "source_no", *ties)


def _best(reads: DataFrame, key: list, quality: str, order: list[str]) -> DataFrame:
    w = W.partitionBy(*key).orderBy(F.desc(quality), *order)
    return reads.withColumn("_rank", F.row_number().over(w))


def remove_duplicate_pairs(reads: DataFrame, *, quality: str, order: list[str], library: str = "lb") -> DataFrame:
    """Of mapped pairs with equal library, place and insert size the one of the largest quality sum stays, with its mate.

    Only pairs on one chromosome are compared, by their left read (isize > 0); other reads pass.
    """
    same = has_bits(F.col("flag"), 1) & has_none(F.col("flag"), 4 | 8) & (F.col("mtid") == F.col("tid"))
    heads = _best(reads.where(same & (F.col("isize") > 0)), [library, "tid", "pos", "isize"], quality, order)
    losers = heads.where("_rank > 1").select(F.col("tid").alias("_t"), F.col("qname").alias("_q")).distinct()
    hit = (F.col("tid") == F.col("_t")) & (F.col("qname") == F.col("_q"))
    tails = reads.where(~F.coalesce(same & (F.col("isize") > 0), F.lit(False)))
    unmatched = tails.where(~F.coalesce(same & (F.col("isize") <= 0), F.lit(False)))
    kept_tails = tails.where(F.coalesce(same & (F.col("isize") <= 0), F.lit(False))).join(losers, hit, "left_anti")
    return heads.where("_rank = 1").drop("_rank").unionByName(kept_tails).unionByName(unmatched)


def remove_duplicate_singles(reads: DataFrame, *, quality: str, order: list[str], library: str = "lb", forced: bool = False) -> DataFrame:
    """Of mapped single reads with equal library, strand and 5' end the one of the largest quality sum stays.

    Unmapped reads pass, and paired ones unless forced.
    """
    reverse = has_bits(F.col("flag"), FLAGS["REVERSE"])
    end = F.when(reverse, F.col("ref_end")).otherwise(F.col("pos"))
    tested = F.coalesce(has_none(F.col("flag"), FLAGS["UNMAP"] | (0 if forced else FLAGS["PAIRED"])), F.lit(False))
    mapped = reads.where(tested).withColumn("_reverse", reverse).withColumn("_end", end)
    best = _best(mapped, [library, "tid", "_reverse", "_end"], quality, order).where("_rank = 1").drop("_rank", "_reverse", "_end")
    return best.unionByName(reads.where(~tested))


def fix_mates(reads: DataFrame, *, order: list[str]) -> DataFrame:
    """Mate place, strand and insert size from the other read of each name: the n-th two rows of a name in order are mates.

    Insert sizes go between 5' ends, from a start counted from 0 to an end not included, and are 0 across chromosomes or where
    either read or mate is marked unmapped. A read whose mate is unmapped is marked so and is no proper pair. A paired read
    without a partner has an unmapped mate on the forward strand and no mate place; the last row of all by name stays as it is
    if it has none.
    """
    w = W.partitionBy("qname").orderBy(*order)
    numbered = reads.withColumn("_n", F.row_number().over(w)).withColumn("_odd", F.col("_n") % 2 == 1)
    other = lambda c: F.when(F.col("_odd"), F.lead(c).over(w)).otherwise(F.lag(c).over(w))
    five = F.when(has_bits(F.col("flag"), FLAGS["REVERSE"]), F.col("ref_end")).otherwise(F.col("pos") - 1)
    ready = numbered.withColumn("_five", five)
    seen = ready.select(*ready.columns, other("tid").alias("_tid"), other("pos").alias("_pos"), other("flag").alias("_flag"), other("_five").alias("_mfive"))
    last = reads.agg(F.max(natural_key(F.col("qname"))).alias("_end"))  # one row
    seen = seen.withColumn("_key", natural_key(F.col("qname"))).join(F.broadcast(last), F.col("_key") == F.col("_end"), "left")
    alone = F.col("_flag").isNull()
    as_is = alone & F.col("_end").isNotNull()
    unmapped = FLAGS["UNMAP"] | FLAGS["MUNMAP"]
    both = ~alone & (F.col("tid") == F.col("_tid")) & has_none(F.col("flag"), unmapped) & has_none(F.col("_flag"), unmapped)
    flag, strand = F.col("flag"), FLAGS["MREVERSE"]
    paired = flag.bitwiseAND(~strand) + F.when(has_bits(F.col("_flag"), FLAGS["REVERSE"]), strand).otherwise(0)
    paired = F.when(has_bits(F.col("_flag"), FLAGS["UNMAP"]), paired.bitwiseOR(FLAGS["MUNMAP"]).bitwiseAND(~FLAGS["PROPER"])).otherwise(paired)
    single = F.when(has_bits(flag, FLAGS["PAIRED"]), flag.bitwiseOR(FLAGS["MUNMAP"]).bitwiseAND(~(strand | FLAGS["PROPER"]))).otherwise(flag)
    own = lambda c, lone, mate: F.when(as_is, F.col(c)).when(alone, lone).otherwise(mate)
    return seen.select(
        *[c for c in reads.columns if c not in ("flag", "mtid", "mpos", "isize")],
        own("flag", single, paired).cast("int").alias("flag"),
        own("mtid", F.lit(-1), F.col("_tid")).cast("int").alias("mtid"),
        own("mpos", F.lit(0), F.col("_pos")).cast("bigint").alias("mpos"),
        own("isize", F.lit(0), F.when(both, F.col("_mfive") - F.col("_five")).otherwise(0)).cast("bigint").alias("isize"),
    )


def valid_reads(reads: DataFrame, n_targets: int) -> DataFrame:
    """Reads with a name whose target and mate's target exist (or are -1 for none)."""
    in_range = lambda c: (F.col(c) >= -1) & (F.col(c) < n_targets)
    return reads.where(in_range("tid") & in_range("mtid") & (F.length("qname") > 0))
