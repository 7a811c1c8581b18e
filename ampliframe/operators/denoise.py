"""True sequences among error copies, read merging, chimeras, and the count table."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ampliframe.functions import feature_id, hamming, let, reverse_complement
from ampliframe.operators.errors import (
    RateTable, estimate_rates, log_likelihood, log_rate_table, log_surplus_chance, nominal_rates,
    transition_counts)
from ampliframe.operators.partitioning import salted_join
from ampliframe.operators.near import BLOCK, GROUP, near_pairs, with_blocks
from ampliframe.sources.stage import Rounds, persist_stage, temporary_stages

UNIQUE = [*GROUP, "sequence"]


def _explained(pairs: DataFrame, table: RateTable, omega: float) -> DataFrame:
    """Pairs (unique, more abundant centre) in which the unique's count is no surprise.

    ``in_group`` is the number of uniques of the sample and direction.
    """
    more = (F.col("centre_n") > F.col("n")) | (
        (F.col("centre_n") == F.col("n")) & (F.col("centre") < F.col("sequence")))
    log_lambda = log_likelihood(F.col("centre"), F.col("sequence"), F.col("quality"), table)
    test = let(F.ln("centre_n") + log_lambda, lambda m: F.struct(
        m.alias("log_mean"), log_surplus_chance(F.col("n"), m).alias("log_chance")))
    return (pairs.filter(more).withColumn("test", test)
            .filter(F.col("test.log_chance") + F.ln("in_group") >= math.log(omega))
            .withColumn("log_mean", F.col("test.log_mean")).drop("test"))


@dataclass
class Prepared:
    """Uniques with the size of their group, and the abundant ones under all blocking keys."""

    uniques: DataFrame
    blocks: DataFrame
    d_max: int


def prepare(uniques: DataFrame, d_max: int = 6) -> Prepared:
    groups = uniques.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("in_group"))
    sized = persist_stage(uniques.join(groups, GROUP), "uniques")
    blocks = persist_stage(with_blocks(sized.filter(F.col("n") >= 2), d_max), "blocks")
    return Prepared(sized, blocks, d_max)


def find_centres(prepared: Prepared, rates: DataFrame | RateTable, omega: float = 1e-40) -> DataFrame:
    """Sequences with n >= 2 that no more abundant centre explains.

    Works in rounds. A sequence that is the most abundant undecided one under all its
    blocking keys has no undecided rival within ``d_max``, so it is a centre; every key has
    at most one such winner per round, so an undecided sequence meets at most ``d_max`` + 1
    centres per round. What these explain is decided too. Each round decides at least the
    largest sequence of every sample, in practice all but a few.
    """
    table = rates if isinstance(rates, RateTable) else log_rate_table(rates)
    d_max, undecided = prepared.d_max, prepared.blocks
    rounds, left = [], Rounds(prepared.uniques.sparkSession, "undecided")
    while not undecided.isEmpty():
        winners = undecided.groupBy(*BLOCK).agg(
            F.min(F.struct((-F.col("n")).alias("minus_n"), "sequence")).alias("w"))
        new = persist_stage(
            winners.groupBy(*GROUP, F.col("w.sequence").alias("centre"), (-F.col("w.minus_n")).alias("centre_n"))
            .count().filter(F.col("count") == d_max + 1).drop("count"), "new-centres")
        rounds.append(new)
        rivals = undecided.join(new.select(*GROUP, F.col("centre").alias("sequence")), UNIQUE, "left_anti")
        met = (salted_join(rivals, with_blocks(new, d_max, "centre"), BLOCK)
               .filter(hamming(F.col("sequence"), F.col("centre")) <= d_max))
        explained = _explained(met, table, omega).select(*UNIQUE).distinct()
        undecided = left.store(rivals.join(explained, UNIQUE, "left_anti"))
    if not rounds:
        return prepared.uniques.limit(0).select(
            *GROUP, F.col("sequence").alias("centre"), F.col("n").alias("centre_n"))
    return reduce(DataFrame.unionByName, rounds)


def denoise(uniques: DataFrame | Prepared, rates: DataFrame, omega: float = 1e-40,
            d_max: int = 6) -> DataFrame:
    """Assigns every unique sequence to its centre.

    ``uniques(sample_id, direction, sequence, n, quality)``. A unique goes to the centre that
    expects most copies of it among those that explain it; single reads that no centre
    explains are left out. Result: ``sample_id, direction, sequence, n, quality, centre``.
    """
    prepared = uniques if isinstance(uniques, Prepared) else prepare(uniques, d_max)
    sized, table = prepared.uniques, log_rate_table(rates)
    centres = persist_stage(find_centres(prepared, table, omega), "centres")
    own = centres.select(*GROUP, F.col("centre").alias("sequence"))
    copies = sized.join(own, UNIQUE, "left_anti")
    best = (_explained(near_pairs(copies, centres, prepared.d_max), table, omega)
            .groupBy(*UNIQUE)
            .agg(F.min(F.struct((-F.col("log_mean")).alias("m"), "centre")).alias("b"),
                 F.first("n").alias("n"), F.first("quality").alias("quality")))
    assigned = best.select(*UNIQUE, "n", "quality", F.col("b.centre").alias("centre"))
    themselves = (sized.join(own, UNIQUE, "left_semi")
                  .select(*UNIQUE, "n", "quality", F.col("sequence").alias("centre")))
    return themselves.unionByName(assigned)


def learn_error_model(uniques: DataFrame, max_iter: int | None = None, omega: float = 1e-40,
                      d_max: int = 6, q_max: int = 45, smoothing: str = "average") -> DataFrame:
    """Alternates denoising and rate estimation until the assignment stays the same, or comes
    back to an earlier one. There are finitely many assignments, so one of the two happens.
    If ``max_iter`` is given and that many rounds end before, a warning says so.

    ``from_base, to_base, q, rate, state, rounds``: the rates of the last round; ``state`` is
    "settled" (the last two assignments are the same), "circle" (an earlier one came back) or "stopped".
    ``smoothing`` as in ``estimate_rates``. Only a two-number fingerprint of the assignment and the rate
    table (16 rows per quality) come to the driver; tables of a round are deleted behind it.
    """
    spark, seen, state = uniques.sparkSession, [], "stopped"
    with temporary_stages(spark):
        prepared = prepare(uniques, d_max)
        rates, rounds = nominal_rates(spark, q_max), Rounds(spark, "rates")
        while max_iter is None or len(seen) < max_iter:
            with temporary_stages(spark):
                assigned = persist_stage(denoise(prepared, rates, omega), "assigned")
                mark = assigned.agg(F.count(F.lit(1)), F.sum(
                    F.xxhash64(*UNIQUE, "centre").cast("decimal(38,0)"))).first()
                if mark in seen:  # the same assignment, or a circle of several
                    state = "settled" if mark == seen[-1] else "circle"
                    break
                seen.append(mark)
                rates = rounds.store(estimate_rates(transition_counts(assigned, weight="n"), q_max, smoothing=smoothing))
        if state == "stopped":
            warnings.warn(f"the assignment still changed in round {max_iter}; raise max_iter", RuntimeWarning, stacklevel=2)
        result = rates.withColumns({"state": F.lit(state), "rounds": F.lit(len(seen))})
        return persist_stage(result, "learned-rates", keep=True)


def count_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (forward, reverse) sequence pairs per sample with their number."""
    return pairs.groupBy("sample_id", "fwd", "rev").agg(F.count(F.lit(1)).alias("n"))


def pairs_of_centres(pair_counts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Pair counts with both mates replaced by their centres; pairs without one are left out."""
    def centre_of(direction: str, column: str) -> DataFrame:
        return assigned.filter(F.col("direction") == direction).select(
            "sample_id", F.col("sequence").alias(column), F.col("centre").alias(f"{column}_centre"))

    return (pair_counts.join(centre_of("F", "fwd"), ["sample_id", "fwd"])
            .join(centre_of("R", "rev"), ["sample_id", "rev"])
            .groupBy("sample_id", F.col("fwd_centre").alias("fwd"), F.col("rev_centre").alias("rev"))
            .agg(F.sum("n").alias("n")))


def merge_pairs(pair_counts: DataFrame, min_overlap: int = 12, max_mismatch: int = 0) -> DataFrame:
    """Joins mates on their longest overlap; pairs without one are dropped.

    The overlap search runs once per distinct (forward, reverse) pair of the whole data, not
    per read and sample. Result: ``sample_id, sequence, n``.
    """
    if max_mismatch < 0:
        raise ValueError("max_mismatch is negative")
    # Grouping by the reverse complement also makes it a plain column for the search.
    counted = persist_stage(
        pair_counts.groupBy("sample_id", "fwd", reverse_complement(F.col("rev")).alias("rc"))
        .agg(F.sum("n").alias("n")), "pairs")
    distinct = counted.select("fwd", "rc").distinct()
    longest = F.least(F.length("fwd"), F.length("rc"))

    def fits(o):
        tail, start = F.right(F.col("fwd"), o), F.left(F.col("rc"), o)
        if max_mismatch == 0:
            return tail == start
        return hamming(tail, start) <= max_mismatch

    overlaps = F.when(longest >= min_overlap, F.filter(
        F.sequence(longest, F.lit(min_overlap), F.lit(-1)), fits))
    merged = (distinct.withColumn("overlap", F.get(overlaps, F.lit(0)))
              .filter(F.col("overlap").isNotNull())
              .select("fwd", "rc", F.concat("fwd", F.substring(
                  F.col("rc"), F.col("overlap") + 1, F.length("rc"))).alias("sequence")))
    return (counted.join(merged, ["fwd", "rc"]).groupBy("sample_id", "sequence")
            .agg(F.sum("n").alias("n")))


def flag_bimeras(asv: DataFrame, min_fold: float = 1.0) -> DataFrame:
    """Flags sequences that are the start of one more abundant sequence of their sample and
    the rest of another one: two different parents, each with n > min_fold * n(child).

    ``asv(sample_id, sequence, n)``. Every sequence is filed under all its starts and all its
    ends; a (sample, start) or (sample, end) keeps its two most abundant members only, which
    is enough to tell whether two different parents exist. So the work is linear in the
    sequences, without pairing them. The empty start and end, which all sequences of a sample share,
    are never filed: the sample's two most abundant sequences answer for them.
    """
    if min_fold < 1:
        raise ValueError("a parent is more abundant than its child: min_fold must be at least 1")
    def mark(text: Column) -> Column:
        """128 bits that stand for a text."""
        return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))

    cuts = let(F.col("sequence"), lambda s: F.transform(
        F.sequence(F.lit(0), F.length(s)), lambda b: F.struct(
            b.alias("cut"), (F.length(s) - b).alias("rest_len"), mark(F.left(s, b)).alias("start"),
            mark(F.substring(s, b + 1, F.length(s))).alias("rest"))))
    marked = asv.select("sample_id", "sequence", mark(F.col("sequence")).alias("id"), "n")
    split = marked.select("sample_id", "id", "n", F.inline(cuts))

    def top_two(rows: DataFrame, group: list[str], name: str) -> DataFrame:
        """Tasks keep two members of a group each before anything is shuffled."""
        order = Window.partitionBy(*group).orderBy(F.col("n").desc(), "id")
        ranked = (rows.select(*group, "id", "n").withColumn("r", F.row_number().over(order))
                  .filter(F.col("r") <= 2))
        # A sequence alone under its text cannot be anyone's parent there.
        return (ranked.groupBy(*group)
                .agg(F.max(F.when(F.col("r") == 1, F.struct("id", "n"))).alias(f"{name}1"),
                     F.max(F.when(F.col("r") == 2, F.struct("id", "n"))).alias(f"{name}2"))
                .filter(F.col(f"{name}2").isNotNull()))

    starts, ends = ["sample_id", "cut", "start"], ["sample_id", "rest_len", "rest"]
    of_start = top_two(split.filter("cut > 0"), starts, "s").hint("merge")
    of_end = top_two(split.filter("rest_len > 0"), ends, "e").hint("merge")

    def of_sample(name: str) -> DataFrame:
        return top_two(marked, ["sample_id"], name)

    # Sort-merge joins, which are split where skewed: the cut rows are many times more than
    # Spark's size estimate says.
    columns = ["sample_id", "id", "n", "s1", "s2", "e1", "e2"]
    inner = split.filter("cut > 0 and rest_len > 0").join(of_start, starts).join(of_end, ends).select(*columns)
    whole_end = salted_join(split.filter("cut = 0").join(of_end, ends).drop("cut", "start"), of_sample("s"), ["sample_id"]).select(*columns)
    whole_start = salted_join(split.filter("rest_len = 0").join(of_start, starts).drop("rest_len", "rest"), of_sample("e"), ["sample_id"]).select(*columns)
    at_cut = inner.unionAll(whole_end).unionAll(whole_start)
    need = F.lit(float(min_fold)) * F.col("n")

    def fits(parent: str):
        return F.coalesce((F.col(f"{parent}.n") > need) & (F.col(f"{parent}.id") != F.col("id")), F.lit(False))

    two_parents = F.lit(False)
    for s in ("s1", "s2"):
        for e in ("e1", "e2"):
            two_parents = two_parents | (fits(s) & fits(e) & (F.col(f"{s}.id") != F.col(f"{e}.id")))
    flagged = (at_cut.filter(two_parents).select("sample_id", "id").distinct()
               .withColumn("bimera", F.lit(True)))
    return (marked.join(flagged, ["sample_id", "id"], "left")
            .select("sample_id", "sequence", "n", F.coalesce("bimera", F.lit(False)).alias("bimera")))


def consensus_bimeras(flags: DataFrame, min_sample_fraction: float = 0.9,
                      ignore_n_negatives: int = 1) -> DataFrame:
    """Sequences that count as chimeras over all samples: flagged in every sample, or in at
    least the given share of samples after leaving out that many unflagged ones."""
    seen = flags.groupBy("sequence").agg(
        F.sum(F.col("bimera").cast("bigint")).alias("flagged"), F.count(F.lit(1)).alias("samples"))
    return seen.filter((F.col("flagged") > 0) & (
        (F.col("flagged") == F.col("samples"))
        | (F.col("flagged") >= (F.col("samples") - ignore_n_negatives) * F.lit(float(min_sample_fraction)))))


def remove_bimeras(asv: DataFrame, chimeras: DataFrame) -> DataFrame:
    return asv.join(chimeras.select("sequence"), "sequence", "left_anti")


def make_feature_table(merged: DataFrame) -> DataFrame:
    return merged.groupBy(feature_id(F.col("sequence")).alias("feature_id"), "sample_id").agg(
        F.sum("n").alias("frequency"))


def rep_seqs(merged: DataFrame) -> DataFrame:
    return merged.select(feature_id(F.col("sequence")).alias("feature_id"), "sequence").distinct()


STEPS = ["input", "filtered", "denoised", "merged", "non_chimeric"]


def denoise_stats(**counts: DataFrame) -> DataFrame:
    """Reads per sample after each step, with percentages of the input.

    Each argument, named as in ``STEPS``, is ``(sample_id, n)``; samples that vanish show 0.
    """
    long = None
    for step in STEPS:
        rows = counts[step].groupBy("sample_id").agg(F.sum("n").alias("n")).withColumn("step", F.lit(step))
        long = rows if long is None else long.unionByName(rows)
    stats = long.groupBy("sample_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("step") == s, F.col("n"))), F.lit(0)).cast("bigint").alias(s) for s in STEPS])
    return stats.withColumns({f"pct_{s}": F.when(F.col("input") != 0, F.lit(100.0) * F.col(s) / F.col("input"))
                              for s in STEPS[1:]})
