"""Scalar expressions on bases and qualities. All are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Phred+33 quality text and the DNA alphabet.
PHRED_OFFSET = 33
MAX_QUALITY = 93
BASES = "ACGT"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def phred(qual: Column) -> Column:
    """Quality text as an array of integer scores."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - PHRED_OFFSET)


def expected_errors(qual: Column) -> Column:
    """Expected number of wrong bases: the sum of 10^(-Q/10), read from a table of all Q."""
    chances = F.array(*[F.lit(10 ** (-q / 10)) for q in range(MAX_QUALITY + 1)])
    return F.aggregate(F.split(qual, ""), F.lit(0.0), lambda total, c: total + F.get(
        chances, F.ascii(c) - PHRED_OFFSET))


def quality_prefix_length(qual: Column, trunc_q: int) -> Column:
    """Number of leading bases before the first one with quality <= trunc_q."""
    last_bad = chr(PHRED_OFFSET + trunc_q)
    return F.length(F.regexp_extract(qual, rf"^[^!-\{last_bad}]*"
                                     if not last_bad.isalnum() else f"^[^!-{last_bad}]*", 0))


def feature_id(seq: Column) -> Column:
    return F.md5(seq)


def kmers(seq: Column, k: int) -> Column:
    """All overlapping words of length k in order; empty for shorter sequences."""
    return let(seq, lambda s: F.when(
        F.length(s) >= k,
        F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))
    ).otherwise(F.array().cast("array<string>")))


def mismatches(a: Column, b: Column) -> Column:
    """Places (from 0) at which two sequences of equal length differ."""
    places = F.transform(F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b")),
                         lambda x, i: F.when(x["a"] != x["b"], i))
    return F.filter(places, lambda i: i.isNotNull())


# Bases that are compared as one text before they are looked at one by one.
PIECE = 20


def hamming(a: Column, b: Column) -> Column:
    """Number of differing positions of two sequences of equal length. Only pieces that differ are looked at base by base."""
    def piece(i: Column) -> Column:
        x, y = F.substring(a, i, F.lit(PIECE)), F.substring(b, i, F.lit(PIECE))
        return F.when(x == y, F.lit(0)).otherwise(F.size(mismatches(x, y)))

    starts = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(PIECE))
    differing = F.aggregate(starts, F.lit(0), lambda total, i: total + piece(i))
    return F.when(a == b, F.lit(0)).otherwise(differing)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
