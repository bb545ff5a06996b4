"""Tab-separated inputs and outputs: alignments, variants, partitions, sites, headers and the tables between the steps.

Readers parse lines with column functions, so only the needed fields are built; malformed numbers give nulls, except
where a docstring says that they fail. Paths go to Spark's readers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoframe.functions import columns as C

# --- fixed values: record types of an alignment header with their tags (required ones first) ---
HEADER_TAGS = {
    "HD": (("VN",), ("SO", "GO")),
    "SQ": (("SN", "LN"), ("AS", "M5", "UR", "SP")),
    "RG": (("ID",), ("SM", "LB", "DS", "PU", "PI", "CN", "DT", "PL")),
    "PG": (("ID",), ("VN", "CL", "PN", "PP")),
}
UNIQUE = {"SQ": "SN", "RG": "ID", "PG": "ID"}
# --- end of fixed values ---


def _field(i: int, sep: str = r"\t") -> Column:
    return F.get(F.split("value", sep), F.lit(i))


def _whole(c: Column) -> Column:
    return c.try_cast("bigint")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignment lines: 11 fields, tags as a map from name to type:value.

    Flags may be decimal, hexadecimal, octal or letters; = and X become M; a mapped read without CIGAR counts as
    unmapped; * and 0 become null chromosome and position.
    """
    rows = _lines(spark, path).where(~F.col("value").startswith("@") & (F.length("value") > 0)).select(F.split("value", r"\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    tags = F.transform(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, F.lit(1), F.lit(2)).alias("k"), F.substring(t, F.lit(4), F.length(t)).alias("v")))
    cigar = C.parse_cigar(at(5))
    flag = C.parse_flag(at(1))
    unmapped = (F.size(cigar) == 0) & flag.bitwiseAND(4).eqNullSafe(0)
    return rows.select(
        at(0).alias("qname"),
        F.when(unmapped, flag.bitwiseOR(4)).otherwise(flag).alias("flag"),
        F.nullif(at(2), F.lit("*")).alias("rname"),
        F.nullif(_whole(at(3)), F.lit(0).cast("bigint")).alias("pos"),
        at(4).try_cast("int").alias("mapq"),
        cigar.alias("cigar"),
        F.nullif(F.when(at(6) == "=", at(2)).otherwise(at(6)), F.lit("*")).alias("mate_rname"),
        F.nullif(_whole(at(7)), F.lit(0).cast("bigint")).alias("mpos"),
        _whole(at(8)).alias("isize"),
        F.nullif(at(9), F.lit("*")).alias("seq"),
        F.nullif(at(10), F.lit("*")).alias("qual"),
        F.map_from_entries(F.filter(tags, lambda t: F.length(t["k"]) == 2)).alias("aux"),
    )


def sam_lines(reads: DataFrame, flags: str = "decimal") -> DataFrame:
    """Alignment lines (column value) of rows as ``read_sam`` gives them. flags: decimal, hex or letters."""
    shown = {"decimal": F.col("flag").cast("string"), "hex": F.concat(F.lit("0x"), F.lower(F.hex("flag"))), "letters": C.flag_letters(F.col("flag"))}[flags]
    mate = F.when(F.col("mate_rname").isNull(), "*").when(F.col("mate_rname") == F.col("rname"), "=").otherwise(F.col("mate_rname"))
    tags = F.transform(F.array_sort(F.map_entries("aux")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    fields = ["qname", shown, F.coalesce("rname", F.lit("*")), F.coalesce("pos", F.lit(0)), "mapq", C.format_cigar(F.col("cigar")), mate, F.coalesce("mpos", F.lit(0)), F.coalesce("isize", F.lit(0)), F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*")), tags]
    return reads.select(F.concat_ws("\t", *fields).alias("value"))


def read_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line_no (order within the header), kind, tags (map) of header lines; comments have their text under ``text``."""
    return header_rows(_lines(spark, path))


def header_rows(lines: DataFrame) -> DataFrame:
    """As ``read_header``, of lines (column value) in order."""
    lines = lines.where(F.col("value").rlike("^@[A-Z]{2}(\t|$)")).withColumn("line_no", F.monotonically_increasing_id())
    kind = F.substring("value", 2, 2)
    parts = F.filter(F.slice(F.split("value", r"\t"), 2, 1_000), lambda t: F.rlike(t, F.lit("^[A-Za-z][A-Za-z0-9]:")))
    tags = F.map_from_entries(F.transform(parts, lambda t: F.struct(F.substring(t, F.lit(1), F.lit(2)), F.substring(t, F.lit(4), F.length(t)))))
    return lines.select("line_no", kind.alias("kind"), F.when(kind == "CO", F.create_map(F.lit("text"), F.substring("value", F.lit(5), F.length("value")))).otherwise(tags).alias("tags"))


def header_faults(header: DataFrame) -> DataFrame:
    """kind, fault for each broken rule: unknown record type or tag, missing tag, name that isn't unique; a good header has no rows."""
    known = F.lit(False)
    faults = []
    for kind, (required, optional) in HEADER_TAGS.items():
        rows = header.where(F.col("kind") == kind)
        for tag in required:
            faults.append(rows.where(F.element_at("tags", tag).isNull()).select("kind", F.lit(f"no {tag}").alias("fault")))
        other = F.array_except(F.map_keys("tags"), F.array(*map(F.lit, (*required, *optional))))
        faults.append(rows.select("kind", F.explode(other).alias("tag")).select("kind", F.concat(F.lit("unknown "), "tag").alias("fault")))
        if kind in UNIQUE:
            again = rows.groupBy("kind", F.element_at("tags", UNIQUE[kind]).alias("name")).agg(F.count("*").alias("n")).where("n > 1 and name is not null")
            faults.append(again.select("kind", F.concat(F.lit("repeats "), "name").alias("fault")))
        known = known | (F.col("kind") == kind)
    faults.append(header.where(~(known | (F.col("kind") == "CO"))).select("kind", F.lit("unknown type").alias("fault")))
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out


def header_targets(header: DataFrame) -> DataFrame:
    """tid, name, length of the targets in order of the header."""
    rows = header.where("kind = 'SQ'").select("line_no", F.element_at("tags", "SN").alias("name"), _whole(F.element_at("tags", "LN")).alias("length"))
    return rows.select((F.row_number().over(W.orderBy("line_no")) - 1).alias("tid"), "name", "length")  # a row for each chromosome


def header_groups(header: DataFrame) -> DataFrame:
    """rg, lb, sm, pl of the read groups."""
    tag = lambda t: F.element_at("tags", t)
    return header.where("kind = 'RG'").select(tag("ID").alias("rg"), tag("LB").alias("lb"), tag("SM").alias("sm"), tag("PL").alias("pl"))


def header_lines(header: DataFrame) -> DataFrame:
    """Header lines (column value) in order, tags as they are."""
    tags = F.when(F.col("kind") == "CO", F.element_at("tags", "text")).otherwise(F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat_ws(":", e["key"], e["value"])), "\t"))
    return header.orderBy("line_no").select(F.concat_ws("\t", F.concat(F.lit("@"), "kind"), tags).alias("value"))


def merge_headers(first: DataFrame, second: DataFrame) -> DataFrame:
    """kind, name, tags, conflict of records of either header: tags are joined, and of two different values of a tag the record is in conflict."""
    name = F.coalesce(*[F.when(F.col("kind") == k, F.element_at("tags", t)) for k, t in UNIQUE.items()])
    side = lambda h, t: h.where(F.col("kind").isin(*UNIQUE)).select("kind", name.alias("name"), F.col("tags").alias(t))
    both = side(first, "x").join(side(second, "y"), ["kind", "name"], "full")
    clash = F.exists(F.map_keys("x"), lambda k: F.element_at("x", k) != F.element_at("y", k))
    extra = F.map_filter("y", lambda k, _: ~F.map_contains_key("x", k))
    return both.select("kind", "name", F.when(F.col("x").isNull(), F.col("y")).when(F.col("y").isNull(), F.col("x")).otherwise(F.map_concat("x", extra)).alias("tags"), F.coalesce(clash, F.lit(False)).alias("conflict"))


def read_partitions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chromosome, p_start, p_end, name of a partition list (separated by white space)."""
    f = lambda i: _field(i, r"\s+")
    return _lines(spark, path).where("length(trim(value)) > 0").withColumn("value", F.trim("value")).select(f(0).alias("chromosome"), _whole(f(1)).alias("p_start"), _whole(f(2)).alias("p_end"), f(3).alias("name"))


def read_sites(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chromosome, pos, indels (proposed lengths) of a site list."""
    f = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).where("length(trim(value)) > 0 and value not like '#%'").select(F.get(f, F.lit(0)).alias("chromosome"), _whole(F.get(f, F.lit(1))).alias("pos"), F.transform(F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0))), lambda t: t.try_cast("int")).alias("indels"))


def read_known_snps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, pos, allele_a, allele_b of a list of known sites."""
    f = lambda i: _field(i, r"\s+")
    return _lines(spark, path).where("length(trim(value)) > 0").select(f(0).alias("id"), _whole(f(2)).alias("pos"), f(3).alias("allele_a"), f(4).alias("allele_b"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """ord, name of a list of names; the order of lines is the order of results. One file."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")).alias("ord", "name"))


#: First lines of the two dialects of read counts and site counts.
NATIVE, OTHER = r"^#\w+ 1\.1", r"^#\w+_VERSION=1\.0"


def _dialect(lines: DataFrame) -> str:
    first = [r.value for r in lines.where(F.col("value").startswith("#")).limit(5).collect()]
    import re

    for name, pattern in (("native", NATIVE), ("other", OTHER)):
        if any(re.match(pattern, x) for x in first):
            return name
    raise ValueError("the first line names no known version")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """chromosome, p_start, p_end, n_t, n_n, gc (null where unknown) of a read count table in either dialect.

    The other dialect has a column before and three after the place. A file without a known version fails.
    """
    lines = _lines(spark, path)
    order = (0, 1, 2, 3, 4, 5) if _dialect(lines) == "native" else (1, 2, 3, 7, 8, 9)
    f = [_field(i) for i in order]
    gc = f[5].try_cast("double")
    rows = lines.where(~F.col("value").startswith("#")).select(f[0].alias("chromosome"), _whole(f[1]).alias("p_start"), _whole(f[2]).alias("p_end"), _whole(f[3]).alias("n_t"), _whole(f[4]).alias("n_n"), F.when(gc >= 0, gc).alias("gc"))
    return rows.where("p_start is not null")  # the header line has no number there


def read_snp_counts(spark: SparkSession, path: str) -> DataFrame:
    """part_no, chromosome, pos, t and n (arrays of four counts), allele_a, allele_b of a site count table in either dialect."""
    lines = _lines(spark, path)
    place = (0, 1, 2) if _dialect(lines) == "native" else (0, 3, 2)
    first = 3 if place[1] == 1 else 4
    four = lambda k: F.array(*[_field(i).try_cast("double") for i in range(k, k + 4)])
    rows = lines.where(~F.col("value").startswith("#")).select(_whole(_field(place[0])).alias("part_no"), _field(place[1]).alias("chromosome"), _whole(_field(place[2])).alias("pos"), four(first).alias("t"), four(first + 4).alias("n"), _field(first + 8).try_cast("int").alias("allele_a"), _field(first + 9).try_cast("int").alias("allele_b"))
    return rows.where("part_no is not null")


def read_vcf(spark: SparkSession, path: str | list[str], *, passing: bool = True) -> DataFrame:
    """Variants with the INFO keys DP, AF, DP_N, AF_N, FR, TG and DB; frequencies are at most 1.

    passing: only rows that pass their filter, aren't in a database of known ones and lie on autosomes.
    """
    rows = _lines(spark, path).where("value not like '#%' and length(value) > 0").select(F.split("value", r"\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    pairs = F.transform(F.split(at(7), ";"), lambda t: F.struct(F.split_part(t, F.lit("="), F.lit(1)).alias("k"), F.regexp_replace(t, "^[^=]*=?", "").alias("v")))
    names = F.transform(pairs, lambda e: e["k"])
    info = F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(names, e["k"]) == i + 1))  # of a repeated key the first
    rows = rows.withColumn("info", info)
    key = lambda k: F.try_element_at("info", F.lit(k))
    number = lambda k: key(k).try_cast("double")
    share = lambda k: F.when(number(k) > 1, 1.0).otherwise(number(k))
    out = rows.select(
        at(0).alias("chromosome"), _whole(at(1)).alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(5).try_cast("double").alias("qual"), at(6).alias("filter"),
        key("DP").try_cast("bigint").alias("dp"), share("AF").alias("af"), key("DP_N").try_cast("bigint").alias("dp_n"), share("AF_N").alias("af_n"), number("FR").alias("fr"), key("TG").alias("tg"), F.map_contains_key("info", "DB").alias("db"),
    )
    return out.where("filter = 'PASS' and not db and chromosome not in ('chrX', 'chrY')") if passing else out


def read_breakpoints(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chromosome, pos of structural variants; names get a leading chr unless they begin with c."""
    name = _field(0)
    return _lines(spark, path).where("value not like '#%' and length(value) > 0").select(F.when(name.startswith("c"), name).otherwise(F.concat(F.lit("chr"), name)).alias("chromosome"), _whole(_field(1)).alias("pos"))


def read_expected_af(spark: SparkSession, path: str | list[str], *, indels: bool = False) -> DataFrame:
    """The first eight columns of a table of expected allele frequencies: rows seen at all, and unless indels are wanted only single-base ones."""
    names = ("mut_id", "chromosome", "pos", "wt", "mut", "af_obs", "coverage", "af_exp")
    kinds = {"pos": "bigint", "af_obs": "double", "coverage": "bigint", "af_exp": "double"}
    rows = _lines(spark, path).select(*[(_field(i).try_cast(kinds[n]) if n in kinds else _field(i)).alias(n) for i, n in enumerate(names)])
    rows = rows.where("af_obs > 0 and pos is not null")
    return rows if indels else rows.where(F.contains("mut_id", F.lit("_SNM")))


def write_tsv(df: DataFrame, path: str, *, order: list[str], parts: int | None = None) -> None:
    """Tab-separated files with a header, rows in order over all files; nulls as -1, doubles to six significant digits, an old result replaced."""
    shown = [F.coalesce(C.six_digits(F.col(n)) if t in ("double", "float") else F.col(n), F.lit(-1).cast(t)).alias(n) if t in ("double", "float", "int", "bigint") else F.col(n) for n, t in df.dtypes]
    ordered = df.orderBy(*order) if parts is None else df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select(*shown).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def mutation_id(key: Column, ref: Column, alt: Column) -> Column:
    """key with _SNM, _DEL or _INS; null for changes of several bases into several."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), F.concat(key, F.lit("_SNM"))).when(F.length(alt) == 1, F.concat(key, F.lit("_DEL"))).when(F.length(ref) == 1, F.concat(key, F.lit("_INS")))


def genotype_rows(mutations: DataFrame) -> DataFrame:
    """mutation_id, ref_counts, var_counts, copies and genotype of single-base mutations for clonal inference: BB where b is 0, else AB."""
    rows = mutations.where((F.length("ref") == 1) & (F.length("alt") == 1))
    var = F.round(F.col("af") * F.col("dp")).cast("bigint")
    return rows.select("mutation_id", (F.col("dp") - var).alias("ref_counts"), var.alias("var_counts"), F.lit(2).alias("normal_cn"), F.col("b").alias("minor_cn"), F.col("a").alias("major_cn"), F.when(F.col("b") == 0, "BB").otherwise("AB").alias("genotype"))
