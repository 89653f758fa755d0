"""Column expressions for bases, qualities and k-mers; register() makes some of them SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def phred(char: Column) -> Column:
    """Quality of one character; below '!' counts as 0."""
    return F.greatest(F.ascii(char) - 33, F.lit(0))


def phreds(qualities: Column) -> Column:
    """Qualities of a string as an array."""
    return F.transform(F.split(qualities, ""), phred)


def low_class(below: int) -> str:
    """A regex class of the characters whose quality is under a limit."""
    return "[^\\x{%x}-\\x{10ffff}]" % (33 + max(below, 0)) if below > 0 else "[^\\x{0}-\\x{10ffff}]"


def complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; order of letters is order of codes."""
    return F.least(kmer, complement(kmer))


def code(kmer: Column) -> Column:
    """Two bits a base, the first base highest; for A, C, G, T only and up to 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def is_dna(kmer: Column) -> Column:
    return F.translate(kmer, "ACGT", "") == ""


def normal_name(text: Column) -> Column:
    """Lower-case letters and digits only, as column names and labels are compared."""
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z]", ""))


def pair_key(header: Column) -> Column:
    """The first token of a header without a /1 or /2 at its end."""
    return F.regexp_replace(F.regexp_extract(header, r"^(\S*)", 1), "/[12]$", "")


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_one(a: Column, b: Column) -> Column:
    """a / b, or 1 if b is 0: precision and recall of nothing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(1.0))


def speedup(a: Column, b: Column) -> Column:
    """a / b where both are positive, else null."""
    return F.when((a > 0) & (b > 0), a / b)


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, straight between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def fraction(x: Column) -> Column:
    """Percentages over 1 up to 100 become shares; all else is kept within 0 and 1."""
    return F.when((x > 1) & (x <= 100), x / 100).otherwise(clamp(x))


def clamp(x: Column) -> Column:
    """x within 0 and 1; null stays null, which greatest and least alone would not do."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def report_number(text: Column) -> Column:
    """A cell of a report: percent signs and thousands commas go; '-' and blanks are null."""
    return F.regexp_replace(F.trim(text), "[%,]", "").try_cast("double")


class Kmers:
    """The windows of a sequence without unknown bases, as rows (start from 0, kmer)."""

    def eval(self, sequence: str, k: int):
        for start in range(len(sequence or "") - k + 1):
            kmer = sequence[start : start + k]
            if not kmer.strip("ACGT"):
                yield start, kmer


def register(spark: SparkSession) -> None:
    """SQL functions canonical_kmer(text), kmer_code(text), mean_phred(text), and the table function kmers(text, k)."""
    spark.udtf.register("kmers", udtf(Kmers, returnType="start int, kmer string"))
    spark.sql("create or replace temporary function canonical_kmer(k string) returns string return least(k, reverse(translate(k, 'ACGT', 'TGCA')))")
    spark.sql("create or replace temporary function kmer_code(k string) returns bigint return cast(conv(translate(k, 'ACGT', '0123'), 4, 10) as bigint)")
    spark.sql("create or replace temporary function mean_phred(q string) returns double return coalesce(try_divide(aggregate(transform(split(q, ''), c -> greatest(ascii(c) - 33, 0)), 0D, (a, x) -> a + x), length(q)), 0D)")
