"""Native column expressions: special functions, alignment flags, CIGAR operations, bases and chromosomes.

Every function takes and returns columns (or their SQL text) and stays inside generated code.
Nulls give nulls unless a docstring says otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: alignment flag bits, their letters, four-bit bases ---
FLAGS = {
    "PAIRED": 1,
    "PROPER": 2,
    "UNMAP": 4,
    "MUNMAP": 8,
    "REVERSE": 16,
    "MREVERSE": 32,
    "READ1": 64,
    "READ2": 128,
    "SECONDARY": 256,
    "QCFAIL": 512,
    "DUP": 1024,
}
FLAG_LETTERS = "pPuUrR12sfd"
NT16 = "=ACMGRSVTWYHKDBN"
#: Reads that a pileup passes over: unmapped, secondary, of failed quality or duplicate.
PILEUP_MASK = 4 | 256 | 512 | 1024
# --- end of fixed values ---


def _quadrature(points: int = 24) -> list[tuple[float, float]]:
    x, w = np.polynomial.legendre.leggauss(points)
    return [(float(a), float(b)) for a, b in zip(x, w)]


def erf_sql(x: str) -> str:
    """SQL text of the error function of SQL text x, by quadrature over [0, min(|x|, 6)]; good to 2e-15."""
    half = f"(least(abs({x}), cast(6 as double)) / 2)"
    terms = " + ".join(f"cast({w!r} as double) * exp(-({half} * cast({1 + n!r} as double)) * ({half} * cast({1 + n!r} as double)))" for n, w in _quadrature())
    return f"(sign({x}) * cast({2 / math.sqrt(math.pi)!r} as double) * {half} * ({terms}))"


# --- fixed values: coefficients of Cody's rational approximations of the error function (1969), highest power first ---
ERF_SMALL = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_SMALL_BELOW = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_MIDDLE = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_MIDDLE_BELOW = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
ERFC_LARGE = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
ERFC_LARGE_BELOW = (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
# --- end of fixed values ---


def erf(x: Column) -> Column:
    """The error function by three rational approximations; one exponential, good to 1e-15."""

    def horner(z: Column, terms: tuple[float, ...]) -> Column:
        total = F.lit(terms[0])
        for t in terms[1:]:
            total = total * z + t
        return total

    y = F.abs(x)
    small = x * horner(x * x, ERF_SMALL) / horner(x * x, ERF_SMALL_BELOW)
    middle = horner(y, ERFC_MIDDLE) / horner(y, ERFC_MIDDLE_BELOW)
    z = 1 / (y * y)
    large = (1 / math.sqrt(math.pi) - z * horner(z, ERFC_LARGE) / horner(z, ERFC_LARGE_BELOW)) / y
    rest = F.exp(-y * y) * F.when(y <= 4, middle).otherwise(large)
    return F.when(y <= 0.46875, small).when(y <= 6, F.signum(x) * (1 - rest)).otherwise(F.signum(x))


def normal_cdf(x: Column, sigma: Column) -> Column:
    """Probability below x of a normal variable with mean 0; a deviation of 0 counts as 1."""
    return (1 + erf(x / (F.when(sigma == 0, 1.0).otherwise(sigma) * math.sqrt(2)))) / 2


def theta_corr(theta: Column, sigma: Column) -> Column:
    """Mean of a folded normal variable: the imbalance that noise sigma makes of theta."""
    s = F.when(sigma == 0, 1e-12).otherwise(sigma)
    return theta * erf(theta / (2 * math.sqrt(2) * s)) + math.sqrt(8 / math.pi) * s * F.exp(-theta * theta / (8 * s * s))


def theta_inverse(observed: Column, sigma: Column, steps: int = 40) -> Column:
    """The imbalance whose folded mean is observed, by bisection on [0, 1]; 0 where noise alone explains it. Nulls give nulls."""
    def run(y: pd.Series, noise: pd.Series) -> pd.Series:
        y, s = y.to_numpy(float), np.where(noise == 0, 1e-12, noise.to_numpy(float))
        node, weight = np.polynomial.legendre.leggauss(24)

        def folded(theta: np.ndarray) -> np.ndarray:
            half = np.minimum(theta / (2 * math.sqrt(2) * s), 6) / 2
            erf_ = 2 / math.sqrt(math.pi) * half * (np.exp(-((half[:, None] * (1 + node)) ** 2)) @ weight)
            return theta * erf_ + math.sqrt(8 / math.pi) * s * np.exp(-theta * theta / (8 * s * s))

        low, high = np.zeros(len(y)), np.ones(len(y))
        for _ in range(steps):
            half = (low + high) / 2
            below = folded(half) < y
            low, high = np.where(below, half, low), np.where(below, high, half)
        out = np.where(y <= folded(np.zeros(len(y))), 0.0, (low + high) / 2)
        return pd.Series(np.where(np.isnan(y) | np.isnan(s), np.nan, out)).astype("Float64").where(~(np.isnan(y) | np.isnan(s)))

    return F.pandas_udf(run, "double")(observed.cast("double"), sigma.cast("double"))


def theta_corr_sql(theta: str, sigma: str) -> str:
    return f"(({theta}) * {erf_sql(f'(({theta}) / (cast({2 * math.sqrt(2)!r} as double) * ({sigma})))')} + cast({math.sqrt(8 / math.pi)!r} as double) * ({sigma}) * exp(-({theta}) * ({theta}) / (8 * ({sigma}) * ({sigma}))))"


# --- fixed values: coefficients of the Lanczos approximation with g = 7 ---
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
# --- end of fixed values ---


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5."""
    z = x - 1
    t = z + 7.5
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def phred_error(quality: Column) -> Column:
    """Error probability of a phred-scaled quality."""
    return F.pow(F.lit(10.0), -quality / 10.0)


def truncate_half(x: Column) -> Column:
    """x + 1/2 cut towards zero."""
    return (x + 0.5).cast("bigint")


def six_digits(x: Column) -> Column:
    """x to six significant digits, as text output of doubles has them."""
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def chromosome_index(name: Column) -> Column:
    """chr1 -> 0 and so on, X -> 22, Y -> 23, other names null."""
    bare = F.regexp_replace(name, "^chr", "")
    number = F.when(F.rlike(bare, F.lit("^[0-9]{1,3}$")), bare.cast("int") - 1)
    return F.when(bare == "X", 22).when(bare == "Y", 23).otherwise(number)


def base_index(base: Column) -> Column:
    """A 0, C 1, G 2, T 3, anything else 4."""
    at = F.instr(F.lit("ACGT"), F.upper(base))
    return F.when((at > 0) & (F.length(base) == 1), at - 1).when(base.isNotNull(), 4)


def base_code(base: Column) -> Column:
    """Four-bit code of a base letter; unknown letters count as N."""
    at = F.instr(F.lit(NT16), F.upper(base))
    return F.when((at > 0) & (F.length(base) == 1), at - 1).when(base.isNotNull(), 15)


def code_base(code: Column) -> Column:
    """Base letter of a four-bit code."""
    return F.substring(F.lit(NT16), code + 1, F.lit(1))


def flag_letters(flag: Column) -> Column:
    """One letter for each bit that is set."""
    return F.concat(*[F.when(flag.bitwiseAND(1 << i) != 0, c).otherwise("") for i, c in enumerate(FLAG_LETTERS)])


def letters_flag(letters: Column) -> Column:
    """The flag of a string of letters."""
    total = F.lit(0)
    for i, c in enumerate(FLAG_LETTERS):
        total = total + F.when(F.contains(letters, F.lit(c)), 1 << i).otherwise(0)
    return F.when(letters.isNotNull(), total)


def parse_flag(text: Column) -> Column:
    """A flag written in decimal, hexadecimal (0x...), octal (0...) or letters."""
    return (
        F.when(F.rlike(text, F.lit("^0[xX][0-9a-fA-F]+$")), F.conv(F.substring(text, F.lit(3), F.length(text)), 16, 10).cast("int"))
        .when(F.rlike(text, F.lit("^0[0-7]+$")), F.conv(text, 8, 10).cast("int"))
        .when(F.rlike(text, F.lit("^[0-9]+$")), F.try_to_number(text, F.lit("99999")).cast("int"))
        .otherwise(letters_flag(text))
    )


def has_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) == bits


def has_none(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) == 0


def parse_cigar(cigar: Column, fold: bool = True) -> Column:
    """array<struct<len, op>> of a CIGAR string; * is empty. fold: = and X become M."""
    parts = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    op = lambda t: F.translate(F.right(t, F.lit(1)), "=X", "MM") if fold else F.right(t, F.lit(1))
    return F.transform(parts, lambda t: F.struct(F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("len"), op(t).alias("op")))


def format_cigar(cigar: Column) -> Column:
    """CIGAR string of array<struct<len, op>>; empty is *."""
    return F.when(F.size(cigar) == 0, "*").otherwise(F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), ""))


def _length(cigar: Column, ops: str) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda a, x: a + F.when(x["op"].isin(*ops), x["len"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    """Reference bases that an alignment covers (M, D, N)."""
    return _length(cigar, "MDN")


def query_length(cigar: Column) -> Column:
    """Bases of the read (M, I, S)."""
    return _length(cigar, "MIS")


def place_cigar(cigar: Column) -> Column:
    """cigar with q0 and r0, where each operation begins in the read and on the reference.

    A soft clip that comes first takes up the read only; a later one also moves on the reference.
    """
    moves = lambda a, y: a["r"] + F.when(y["op"].isin("M", "D", "N") | ((y["op"] == "S") & (a["n"] > 0)), y["len"]).otherwise(0)
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("r"))
    before = lambda i: F.slice(cigar, F.lit(1), i)
    return F.transform(
        cigar,
        lambda x, i: F.struct(
            x["op"].alias("op"),
            x["len"].alias("len"),
            _length(before(i), "MIS").alias("q0"),
            F.aggregate(before(i), begin, lambda a, y: F.struct((a["n"] + 1).alias("n"), moves(a, y).alias("r")))["r"].alias("r0"),
            i.alias("number"),
        ),
    )


def ucsc_bin(begin: Column, end: Column) -> Column:
    """The smallest bin of the hierarchical binning scheme that holds [begin, end), zero-based."""
    last = end - 1
    out = F.lit(0)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(begin, shift) == F.shiftright(last, shift), offset + F.shiftright(begin, shift)).otherwise(out)
    return out


def region_bins(begin: Column, end: Column) -> Column:
    """All bins that may hold something overlapping [begin, end)."""
    last = F.least(end, F.lit(1 << 29)) - 1
    return F.concat(F.array(F.lit(0).cast("bigint")), *[F.sequence(o + F.shiftright(begin, s), o + F.shiftright(last, s)).cast("array<bigint>") for s, o in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))])


def natural_key(name: Column) -> Column:
    """A string that sorts names with their runs of digits by value."""
    runs = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda t: F.when(F.rlike(t, F.lit("^[0-9]")), F.lpad(F.regexp_replace(t, "^0+(?=[0-9])", ""), 20, "0")).otherwise(t)), "")


def sex_factor(chromosome: Column, sex: Column) -> Column:
    """Copies of a chromosome against autosomes: X 1 (f) or 1/2 (m), Y 0 or 1/2, else 1. chromosome is an index."""
    return F.when(chromosome == 22, F.when(sex == "f", 1.0).otherwise(0.5)).when(chromosome == 23, F.when(sex == "f", 0.0).otherwise(0.5)).otherwise(1.0)


def solexa_to_phred(quality: Column) -> Column:
    """Array of qualities of an old scale, as files store them (letters less 33), to phred-scaled ones, at most 93."""
    return F.transform(quality, lambda q: F.least(F.floor(10 * F.log10(1 + F.pow(F.lit(10.0), (F.least(q, F.lit(127)) - 31) / 10.0)) + 0.499), F.lit(93)).cast("int"))
