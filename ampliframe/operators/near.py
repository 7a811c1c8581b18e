"""Sequences that differ in few positions, found by exact blocking.

Positions are dealt out to d+1 strides (0, d+1, 2(d+1), … is one of them). Two sequences of
equal length with at most d differences agree completely on at least one stride, so an
equi-join on (stride, its text) finds every such pair. Strides run over the whole sequence:
a conserved region, which most sequences share, never makes up a key by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ampliframe.functions import mismatches
from ampliframe.operators.partitioning import salted_join

GROUP = ["sample_id", "direction"]
BLOCK = [*GROUP, "len", "stride", "text"]


def _strides(seq: Column, d_max: int) -> Column:
    texts = [F.struct(F.lit(j).alias("stride"), F.regexp_replace(
        F.substring(seq, F.lit(j + 1), F.length(seq)), f"(.).{{0,{d_max}}}", "$1").alias("text"))
        for j in range(d_max + 1)]
    return F.array(*texts)


def with_blocks(df: DataFrame, d_max: int, column: str = "sequence") -> DataFrame:
    """Each row once per stride, with the columns of ``BLOCK``."""
    return df.select("*", F.length(column).alias("len"), F.inline(_strides(F.col(column), d_max)))


def near_pairs(uniques: DataFrame, centres: DataFrame, d_max: int, salts: int = 16) -> DataFrame:
    """All (unique, centre) pairs of one sample and direction within ``d_max`` substitutions.

    ``uniques(sample_id, direction, sequence, …)`` against the far fewer
    ``centres(sample_id, direction, centre, …)``; unique is never paired with unique. A pair
    that agrees on several strides is kept for the first of them only, so no second shuffle
    is needed to remove repeats.
    """
    left = with_blocks(uniques, d_max)
    right = with_blocks(centres, d_max, "centre")
    places = mismatches(F.col("sequence"), F.col("centre"))
    return (salted_join(left, right, BLOCK, salts)
            .withColumn("_places", places)
            .filter((F.size("_places") <= d_max) & (_first_shared(F.col("_places"), d_max) == F.col("stride")))
            .withColumn("distance", F.size("_places"))
            .drop("len", "stride", "text", "_places"))


def _first_shared(places: Column, d_max: int) -> Column:
    """Lowest stride without a difference."""
    return F.get(F.array_except(F.sequence(F.lit(0), F.lit(d_max)),
                                F.transform(places, lambda p: p % (d_max + 1))), F.lit(0))
