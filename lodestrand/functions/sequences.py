"""Column functions over nucleotide strings, and their SQL registrations.

All are built-in expressions: they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The alphabet, its complement, and the order in which neighbours are generated.
ALPHABET, COMPLEMENT, NEIGHBOUR_ORDER = "ACGT", "TGCA", "ATCG"
#: Fixed value: the last count in a header.
HEADER_COUNT = r"N:(-?\d+(?:\.\d+)?)(?!.*N:)"


def is_valid(s: Column | str) -> Column:
    """Only A, C, G and T; the empty string is valid, null is not."""
    return F.coalesce(F.length(F.translate(s, ALPHABET, "")) == 0, F.lit(False))


def revcomp(s: Column | str) -> Column:
    """Reverse complement; other characters are kept."""
    return F.reverse(F.translate(s, ALPHABET, COMPLEMENT))


def trimmed(s: Column | str) -> Column:
    """Without white space at the ends."""
    return F.btrim(s, F.lit(" \t\r\n\x0b\x0c"))


def parts(length: Column, k: int) -> Column:
    """Array of (part, st, sz): ``k`` contiguous parts of a length, the first ones longer by one."""
    if k < 1:
        raise ValueError("at least one part is needed")
    n = length.cast("int")
    size = F.floor(n / k).cast("int")
    more = n % k

    def part(i: Column) -> Column:
        return F.struct(
            i.alias("part"), (i * size + F.least(i, more)).cast("int").alias("st"), (size + F.when(i < more, 1).otherwise(0)).cast("int").alias("sz")
        )

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), part)


def piece(s: Column, start: Column, size: Column) -> Column:
    """``size`` characters from a start that counts from 0."""
    return F.substring(s, start + 1, size)


def header_count(header: Column | str) -> Column:
    """The last ``N:<number>`` of a header as a whole number; an error if there is none."""
    found = F.regexp_extract(header, HEADER_COUNT, 1)
    missing = F.raise_error(F.concat(F.lit("no count in header: "), F.col(header) if isinstance(header, str) else header))
    return F.when(found != "", found.cast("long")).otherwise(missing.cast("long"))


def mismatches(a: Column, b: Column) -> Column:
    """Positions (from 0) at which two strings of one length differ."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.length(a) - 1, F.lit(0))), lambda i: F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1)))


def generation_key(s: Column, neighbour: Column) -> Column:
    """Place of a neighbour among those generated from ``s``: fewer mismatches
    first, then their positions, then the new letters in the order A, T, C, G."""
    at = mismatches(s, neighbour)
    letters = F.transform(at, lambda i: F.position(F.substring(neighbour, i + 1, F.lit(1)), F.lit(NEIGHBOUR_ORDER)))
    return F.struct(F.size(at).alias("n"), at.alias("at"), letters.alias("letters"))


def hamming_neighbors(s: Column, mismatches_: int = 1) -> Column:
    """Array of (ordinal, neighbour) within one or two mismatches, in generation order."""
    if mismatches_ not in (1, 2):
        raise ValueError("one or two mismatches are supported")
    letters = F.array(*[F.lit(c) for c in NEIGHBOUR_ORDER])
    places = F.sequence(F.lit(1), F.length(s))
    one_of = lambda text, i: F.transform(
        F.filter(letters, lambda c: c != F.substring(text, i, F.lit(1))), lambda c: F.overlay(text, c, i, F.lit(1))
    )
    single = F.flatten(F.transform(places, lambda i: one_of(s, i)))
    every = single
    if mismatches_ == 2:
        pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))

        def double(p: Column) -> Column:
            first = F.filter(letters, lambda c: c != F.substring(s, p["i"], F.lit(1)))
            return F.flatten(F.transform(first, lambda c: F.transform(
                F.filter(letters, lambda e: e != F.substring(s, p["j"], F.lit(1))),
                lambda e: F.overlay(F.overlay(s, c, p["i"], F.lit(1)), e, p["j"], F.lit(1)),
            )))

        every = F.concat(single, F.flatten(F.transform(pairs, double)))
    nothing = F.array().cast("array<struct<ordinal:int,neighbor:string>>")
    numbered = F.transform(every, lambda x, i: F.struct(i.cast("int").alias("ordinal"), x.alias("neighbor")))
    return F.when(F.length(s) > 0, numbered).otherwise(nothing)


def register(spark: SparkSession) -> None:
    """SQL functions for the session: is_valid_read, revcomp, read_parts, header_count."""
    for name, args, kind, body in (
        ("is_valid_read", "s STRING", "BOOLEAN", "coalesce(length(translate(s, 'ACGT', '')) = 0, false)"),
        ("revcomp", "s STRING", "STRING", "reverse(translate(s, 'ACGT', 'TGCA'))"),
        ("read_parts", "n INT, k INT", "ARRAY<STRUCT<part INT, st INT, sz INT>>",
         "transform(sequence(0, k - 1), i -> named_struct('part', i, 'st', cast(i * (n div k) + least(i, n % k) AS INT), 'sz', cast(n div k + if(i < n % k, 1, 0) AS INT)))"),
        ("header_count", "h STRING", "BIGINT", r"cast(regexp_extract(h, 'N:(-?\\d+(?:\\.\\d+)?)(?!.*N:)', 1) AS BIGINT)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
