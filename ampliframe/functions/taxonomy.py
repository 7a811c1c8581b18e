"""Expressions on lineage text such as ``D_0__Bacteria;D_1__Firmicutes``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def split_taxonomy(taxon: Column) -> Column:
    return F.transform(F.split(taxon, ";"), lambda x: F.trim(x))


def rank_of(label: Column) -> Column:
    """``D_3__Name`` as a struct of level 3 and name; both NULL for other labels."""
    pattern = "^D_([0-9]+)__(.*)$"
    ranked = label.rlike(pattern)
    return F.struct(
        F.when(ranked, F.regexp_extract(label, pattern, 1).cast("int")).alias("level"),
        F.when(ranked, F.regexp_extract(label, pattern, 2)).alias("name"))


def lineage_prefix(taxon: Column, level: Column | int, pad: str = "__") -> Column:
    """The first ``level`` ranks joined by ``;``, padded where the lineage is shorter."""
    level = F.lit(level) if isinstance(level, int) else level
    ranks = split_taxonomy(taxon)
    missing = F.greatest(level - F.size(ranks), F.lit(0))
    return F.array_join(F.slice(F.concat(ranks, F.array_repeat(F.lit(pad), missing)),
                                F.lit(1), level), ";")


def parse_terms(text: str | None) -> list[str]:
    return [term.strip() for term in (text or "").split(",") if term.strip()]


def matches_any(taxon: Column, terms: list[str], mode: str = "contains") -> Column:
    """True where the lineage contains (or equals) any term, ignoring case.

    Terms are literal text: ``_`` is an underscore, never a wildcard.
    """
    if mode not in ("contains", "exact"):
        raise ValueError(f"unknown mode {mode!r}")
    lowered = F.lower(taxon)
    tests = [lowered == term.lower() if mode == "exact"
             else F.contains(lowered, F.lit(term.lower())) for term in terms]
    return reduce(lambda a, b: a | b, tests, F.lit(False))
