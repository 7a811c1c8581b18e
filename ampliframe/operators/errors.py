"""Error rates of the sequencer and the abundance test that uses them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ampliframe.functions.sequence import BASES, MAX_QUALITY, PHRED_OFFSET, let

# The tail series runs until a term is below exp(-SERIES_DIGITS) of the sum, MIN_TERMS at least.
SERIES_DIGITS = 37.0
MIN_TERMS = 50


def nominal_rates(spark: SparkSession, q_max: int = 45) -> DataFrame:
    """Rates as the quality scores claim: 10^(-Q/10), spread over the three wrong bases.

    Scores 0 and 1 claim more errors than a random base has; they count as random.
    """
    bases = F.split(F.lit(BASES), "")
    grid = (spark.range(q_max + 1).select(F.col("id").cast("int").alias("q"), F.explode(bases).alias("from_base"))
            .select("*", F.explode(bases).alias("to_base")))
    wrong = F.least(F.pow(F.lit(10.0), -F.col("q") / 10), F.lit(0.75))
    rate = F.when(F.col("from_base") == F.col("to_base"), 1 - wrong).otherwise(wrong / 3)
    return grid.select("from_base", "to_base", "q", rate.alias("rate"))


def transition_counts(assigned: DataFrame, centre: str = "centre", sequence: str = "sequence",
                      quality: str = "quality", weight: str | None = None) -> DataFrame:
    """How often a base of the centre was read as which base, by quality."""
    places = F.arrays_zip(F.split(F.col(centre), "").alias("f"), F.split(F.col(sequence), "").alias("t"),
                          F.split(F.col(quality), "").alias("q"))
    w = F.col(weight) if weight else F.lit(1)
    rows = assigned.select(w.cast("bigint").alias("w"), F.inline(places))
    return (rows.groupBy(F.col("f").alias("from_base"), F.col("t").alias("to_base"), "q")
            .agg(F.sum("w").alias("n"))
            .select("from_base", "to_base", (F.ascii("q") - PHRED_OFFSET).alias("q"), "n"))


# Rates of a wrong base that a fitted line may give, at the lowest and the highest.
LOWEST_RATE, HIGHEST_RATE = 1e-7, 0.25


def estimate_rates(counts: DataFrame, q_max: int = 45, reach: int = 2, smoothing: str = "average") -> DataFrame:
    """Rates from transition counts, smoothed over ``reach`` neighbouring qualities.

    "average": add-one counts summed over the neighbours. "linear": per pair of bases a straight line
    through log10((n + 1) / (all + 4)) of the neighbours, weighted by the reads of the true base at each
    quality (plus one), in closed form from window sums; the rate at which a base stays is what the wrong
    ones leave. The grid has 16 x (q_max + 1) rows whatever the data size.
    """
    if smoothing not in ("average", "linear"):
        raise ValueError(f"unknown smoothing {smoothing!r}")
    spark = counts.sparkSession
    grid = nominal_rates(spark, q_max).select("from_base", "to_base", "q")
    near = Window.partitionBy("from_base", "to_base").orderBy("q").rangeBetween(-reach, reach)
    row = Window.partitionBy("from_base", "q")
    filled = grid.join(counts, ["from_base", "to_base", "q"], "left")
    if smoothing == "average":
        smoothed = filled.withColumn("s", F.sum(F.coalesce("n", F.lit(0))).over(near) + 1)
        return smoothed.select("from_base", "to_base", "q", (F.col("s") / F.sum("s").over(row)).alias("rate"))
    n = filled.withColumn("n", F.coalesce("n", F.lit(0)).cast("double")).withColumn("all", F.sum("n").over(row))
    y, w, x = F.log10((F.col("n") + 1) / (F.col("all") + 4)), F.col("all") + 1, F.col("q").cast("double")
    sums = n.select("*", *[F.sum(e).over(near).alias(name) for name, e in (
        ("sw", w), ("swx", w * x), ("swxx", w * x * x), ("swy", w * y), ("swxy", w * x * y))])
    spread = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
    slope = F.when(spread > 0, (F.col("sw") * F.col("swxy") - F.col("swx") * F.col("swy")) / spread).otherwise(F.lit(0.0))
    fitted = (F.col("swy") + slope * (F.col("sw") * x - F.col("swx"))) / F.col("sw")
    wrong = F.least(F.greatest(F.pow(F.lit(10.0), fitted), F.lit(LOWEST_RATE)), F.lit(HIGHEST_RATE))
    other = F.col("from_base") != F.col("to_base")
    rates = sums.select("from_base", "to_base", "q", F.when(other, wrong).otherwise(F.lit(0.0)).alias("wrong"))
    return rates.select("from_base", "to_base", "q", F.when(other, F.col("wrong")).otherwise(
        1 - F.sum("wrong").over(row)).alias("rate"))


@dataclass
class RateTable:
    """ln of the rates as one literal array, by (from, to, q)."""

    values: Column
    q_max: int


def log_rate_table(rates: DataFrame) -> RateTable:
    """Brings the rates (at most 16 x 94 rows) into an expression."""
    rows = rates.limit(16 * (MAX_QUALITY + 1) + 1).collect()
    if len(rows) > 16 * (MAX_QUALITY + 1):
        raise ValueError("more rates than base pairs and qualities")
    q_max = max(r.q for r in rows)
    by_key = {(r.from_base, r.to_base, r.q): r.rate for r in rows}
    values = [math.log(by_key[a, b, q]) for a in BASES for b in BASES for q in range(q_max + 1)]
    return RateTable(F.expr(f"array({', '.join(f'{v!r}D' for v in values)})"), q_max)


def log_likelihood(centre: Column, sequence: Column, quality: Column, table: RateTable) -> Column:
    """ln of the chance that a read of ``centre`` comes out as ``sequence``."""
    places = F.arrays_zip(F.split(centre, "").alias("f"), F.split(sequence, "").alias("t"),
                          F.split(quality, "").alias("q"))

    def term(p: Column) -> Column:
        q = F.least(F.ascii(p["q"]) - PHRED_OFFSET, F.lit(table.q_max))
        f, t = F.instr(F.lit(BASES), p["f"]), F.instr(F.lit(BASES), p["t"])
        rate = F.get(table.values, ((f - 1) * 4 + t - 1) * (table.q_max + 1) + q)
        # Any other letter than a base says nothing about the read.
        return F.when((f > 0) & (t > 0), rate).otherwise(F.lit(0.0))

    return F.aggregate(places, F.lit(0.0), lambda total, p: total + term(p))


def log_surplus_chance(n: Column, log_mean: Column) -> Column:
    """ln P(X >= n | X >= 1) for a Poisson X, given ln of its mean; 0 where n is no surplus
    (n = 1 or n <= mean).

    The mean itself may be too small for a double; its logarithm is not.
    """
    return let(log_mean, lambda m: _log_surplus_chance(n, m))


def _terms(a: Column, log_mean: Column) -> Column:
    """Terms after which the tail series changes no more in double precision.

    Terms shrink at least by mean / (a + 1) each; near the mean by exp(-i^2 / 2(a + i)) in all.
    """
    shrink = F.ln(a + 1) - log_mean
    few = F.when(shrink > 0, SERIES_DIGITS / shrink)
    many = SERIES_DIGITS + F.sqrt(SERIES_DIGITS ** 2 + 2 * SERIES_DIGITS * a)
    return F.greatest(F.lit(MIN_TERMS), F.ceil(F.least(few, many)).cast("int"))


def _log_surplus_chance(n: Column, log_mean: Column) -> Column:
    a, mean = n.cast("double"), F.exp(log_mean)
    log_factorial = (a * F.ln(a) - a + 0.5 * F.ln(2 * math.pi * a)
                     + 1 / (12 * a) - 1 / (360 * F.pow(a, F.lit(3.0))))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add_term(acc: Column, i: Column) -> Column:
        term = acc["term"] * mean / (a + i)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    series = F.aggregate(F.sequence(F.lit(1), _terms(a, log_mean)), start, add_term,
                         lambda acc: acc["sum"])
    log_tail = F.least(-mean + a * log_mean - log_factorial + F.ln(series), F.lit(0.0))
    log_any = F.when(mean < 1e-8, log_mean).otherwise(F.ln(1 - F.exp(-mean)))
    return F.when((n <= 1) | (a <= mean), F.lit(0.0)).otherwise(F.least(log_tail - log_any, F.lit(0.0)))
