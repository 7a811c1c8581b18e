"""Summaries of a count table and of its sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ampliframe.operators.partitioning import weighted_quantiles
from ampliframe.operators.reads import SUMMARY_FRACTIONS, SUMMARY_NAMES


def frequency_per_sample(ft: DataFrame) -> DataFrame:
    return ft.groupBy("sample_id").agg(
        F.sum("frequency").alias("frequency"), F.count(F.lit(1)).alias("features"))


def frequency_per_feature(ft: DataFrame) -> DataFrame:
    return ft.groupBy("feature_id").agg(
        F.sum("frequency").alias("frequency"), F.count(F.lit(1)).alias("samples"))


def table_overview(ft: DataFrame) -> DataFrame:
    """Samples, features and total count. Distinct ids are counted on reduced tables: the
    rows are first grouped by their id, which map-side aggregation makes small."""
    samples = ft.groupBy("sample_id").agg(F.sum("frequency").alias("f")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("f").alias("total_frequency"))
    features = ft.select("feature_id").distinct().agg(F.count(F.lit(1)).alias("features"))
    # Both sides are one row.
    return samples.withColumn("_one", F.lit(1)).join(features.withColumn("_one", F.lit(1)), "_one").select(
        "samples", "features", F.coalesce("total_frequency", F.lit(0)).cast("bigint").alias("total_frequency"))


def frequency_quantiles(frequencies: DataFrame) -> DataFrame:
    """Five-number summary and mean of a ``frequency`` column."""
    counted = frequencies.groupBy("frequency").agg(F.count(F.lit(1)).alias("n"))
    quartiles = weighted_quantiles(counted, "frequency", "n", {"first_quartile": 0.25, "median": 0.5, "third_quartile": 0.75})
    others = counted.agg(
        F.min("frequency").alias("minimum"), F.max("frequency").alias("maximum"),
        (F.sum(F.col("frequency") * F.col("n")) / F.sum("n")).alias("mean"))
    # Both sides are one row.
    return others.withColumn("_one", F.lit(1)).join(quartiles.withColumn("_one", F.lit(1)), "_one").select(
        "minimum", "first_quartile", "median", "third_quartile", "maximum", "mean")


def retention_at_depth(ft: DataFrame, depths: list[int], by: str | None = None,
                       metadata: DataFrame | None = None) -> DataFrame:
    """Samples and counts kept at each candidate depth, if wanted per metadata group."""
    totals = ft.groupBy("sample_id").agg(F.sum("frequency").alias("frequency"))
    groups = ["depth"]
    if by is not None:
        totals = totals.join(metadata.select("sample_id", by), "sample_id", "left")
        groups.append(by)
    every = F.array(*[F.lit(int(d)) for d in depths])
    reached = F.col("frequency") >= F.col("depth")
    # Depths that no sample reaches keep nothing, but they are in the answer.
    return (totals.withColumn("depth", F.explode(every))
            .groupBy(*groups)
            .agg(F.count_if(reached).alias("samples_kept"),
                 F.sum(F.when(reached, F.col("depth")).otherwise(0).cast("bigint")).alias("counts_kept")))


def sequence_length_stats(seqs: DataFrame) -> DataFrame:
    length = F.length("sequence")
    quantiles = F.percentile(length, F.array(*[F.lit(f) for f in SUMMARY_FRACTIONS]))
    return seqs.agg(
        F.count(F.lit(1)).alias("n"), F.min(length).alias("min_len"), F.max(length).alias("max_len"),
        F.avg(length).alias("mean_len"), (F.max(length) - F.min(length)).alias("range_len"),
        F.stddev_samp(length).alias("std_len"), quantiles.alias("_q")
    ).select("n", "min_len", "max_len", "mean_len", "range_len", "std_len",
             *[F.col("_q")[i].alias(name) for i, name in enumerate(SUMMARY_NAMES)])


def tabulate_seqs(seqs: DataFrame) -> DataFrame:
    return seqs.select("feature_id", F.length("sequence").alias("len"), "sequence").orderBy("feature_id")
