"""Lineage filters, rank summaries and the tables behind a composition plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ampliframe.functions import lineage_prefix, matches_any, parse_terms, split_taxonomy
from ampliframe.operators.lookup import attach_metadata, one_row_per, require_metadata, semi_keep
from ampliframe.operators.partitioning import parts_of
from ampliframe.operators.reshape import to_wide

# Counts of one part while they are collapsed. Parts grow in number with the table, so a task's groups do not.
COUNTS_PER_PART = 1 << 17


def filter_taxonomy(taxonomy: DataFrame, include: str | None = None, exclude: str | None = None,
                    mode: str = "contains") -> DataFrame:
    """Rows whose lineage has an include term and no exclude term."""
    wanted, unwanted = parse_terms(include), parse_terms(exclude)
    keep: Column = matches_any(F.col("taxon"), wanted, mode) if wanted else F.lit(True)
    if unwanted:
        keep = keep & ~matches_any(F.col("taxon"), unwanted, mode)
    return taxonomy.filter(keep)


def keep_features(taxonomy: DataFrame, include: str | None = None, exclude: str | None = None,
                  mode: str = "contains") -> DataFrame:
    return filter_taxonomy(taxonomy, include, exclude, mode).select("feature_id")


def require_taxonomy(df: DataFrame, taxonomy: DataFrame) -> None:
    lost = [r.feature_id for r in df.select("feature_id").distinct()
            .join(taxonomy, "feature_id", "left_anti").limit(5).collect()]
    if lost:
        raise ValueError(f"features without taxonomy, among them {lost}")


def _filter_by_taxon(df, taxonomy, include, exclude, mode, missing):
    if missing not in ("error", "drop"):
        raise ValueError(f"unknown choice {missing!r}")
    if missing == "error":
        require_taxonomy(df, taxonomy)
    return semi_keep(df, keep_features(taxonomy, include, exclude, mode))


def filter_table_by_taxon(ft: DataFrame, taxonomy: DataFrame, include: str | None = None,
                          exclude: str | None = None, mode: str = "contains",
                          missing: str = "error") -> DataFrame:
    return _filter_by_taxon(ft, taxonomy, include, exclude, mode, missing)


def filter_seqs_by_taxon(seqs: DataFrame, taxonomy: DataFrame, include: str | None = None,
                         exclude: str | None = None, mode: str = "contains",
                         missing: str = "error") -> DataFrame:
    return _filter_by_taxon(seqs, taxonomy, include, exclude, mode, missing)


def dropped_samples(before: DataFrame, after: DataFrame) -> DataFrame:
    """Samples that had counts before a filter and have none after it."""
    return before.select("sample_id").distinct().join(
        after.select("sample_id").distinct(), "sample_id", "left_anti")


def _with_lineage(ft: DataFrame, lineages: DataFrame, missing: str) -> DataFrame:
    """Counts with ``taxon``. A feature without a lineage stops the job ("error") when its row is
    read, without a job of its own, or is left out ("drop")."""
    if missing not in ("error", "drop"):
        raise ValueError(f"unknown choice {missing!r}")
    if missing == "drop":
        return ft.join(lineages, "feature_id")
    known = ft.join(lineages.withColumn("_known", F.lit(True)), "feature_id", "left")
    complaint = F.raise_error(F.concat(F.lit("feature without taxonomy: "), F.coalesce("feature_id", F.lit("NULL"))))
    return known.withColumn("taxon", F.when(F.col("_known"), F.col("taxon")).otherwise(complaint)).drop("_known")


def _summed(ft: DataFrame, lineages: DataFrame, missing: str, parts: int) -> DataFrame:
    """Counts per sample and ``taxon`` of the feature, in ``parts`` parts. A group has no more rows than the
    table has features."""
    dealt = ft.select("feature_id", "sample_id", "frequency").repartition(parts, "feature_id")
    return (_with_lineage(dealt, lineages, missing).repartition(parts, "taxon", "sample_id")
            .groupBy("taxon", "sample_id").agg(F.sum("frequency").alias("frequency")))


def collapse_taxa(ft: DataFrame, taxonomy: DataFrame, level: int, pad: str = "__",
                  missing: str = "error") -> DataFrame:
    """Counts per sample of the first ``level`` ranks.

    Prefixes are cut on the taxonomy, once per feature, not once per count row.
    """
    prefixes = taxonomy.select("feature_id", lineage_prefix(F.col("taxon"), level, pad).alias("taxon"))
    return _summed(ft, prefixes, missing, parts_of(ft, COUNTS_PER_PART))


def max_level(taxonomy: DataFrame) -> int:
    return taxonomy.agg(F.max(F.size(split_taxonomy(F.col("taxon"))))).first()[0] or 0


def _by_sample(ft: DataFrame, taxonomy: DataFrame, levels: int, pad: str, missing: str) -> DataFrame:
    """Counts per lineage of ``levels`` ranks and sample, all of a sample in one part: at most a row per lineage."""
    if ";" in pad:
        raise ValueError("the pad is a rank, so it holds no ';'")
    parts = parts_of(ft, COUNTS_PER_PART)
    whole = taxonomy.select("feature_id", lineage_prefix(F.col("taxon"), levels, pad).alias("taxon"))
    return _summed(ft, whole, missing, parts).repartition(parts, "sample_id")


def _every_level(by_sample: DataFrame, levels: int, *of_sample: str) -> DataFrame:
    """Sums at all ranks, without a shuffle: the samples stay where they are, with what they have in ``of_sample``."""
    ranks = F.array(*[F.struct(F.lit(i).alias("level"), F.substring_index("taxon", ";", i).alias("prefix"))
                      for i in range(1, levels + 1)])
    return (by_sample.select("sample_id", "frequency", *of_sample, F.inline(ranks))
            .groupBy("level", F.col("prefix").alias("taxon"), "sample_id")
            .agg(F.sum("frequency").alias("frequency"), *[F.max(c).alias(c) for c in of_sample]))


def collapse_all_levels(ft: DataFrame, taxonomy: DataFrame, levels: int | None = None,
                        pad: str = "__", missing: str = "error") -> DataFrame:
    """Counts per sample at every rank.

    Counts are first summed per full lineage and sample; only these sums are repeated for
    the ranks, not every feature row, and never shuffled again.
    """
    levels = levels or max_level(taxonomy) or 1
    return _every_level(_by_sample(ft, taxonomy, levels, pad, missing), levels)


def relative_abundance(counts: DataFrame, by: list[str] | str = "sample_id",
                       value: str = "frequency") -> DataFrame:
    """Adds ``share`` = count / total of its group.

    Totals come from an aggregate joined back, not from a window: a window would bring all
    rows of a large sample into one task.
    """
    by = [by] if isinstance(by, str) else by
    totals = counts.groupBy(*by).agg(F.sum(value).alias("_total"))
    return (counts.join(totals, by)
            .withColumn("share", F.when(F.col("_total") != 0, F.col(value) / F.col("_total")))
            .drop("_total"))


def sort_samples(shares: DataFrame, metadata: DataFrame | None = None, column: str | None = None,
                 taxon: str | None = None, descending: bool = True) -> DataFrame:
    """Composition rows with samples ordered by a metadata column or by a taxon's share.

    Adds ``sort_value``; samples without the taxon have share 0. Ties go by sample id.
    """
    if (column is None) == (taxon is None):
        raise ValueError("give either a metadata column or a taxon")
    if taxon is not None:
        keys = shares.groupBy("sample_id").agg(F.coalesce(
            F.max(F.when(F.col("taxon") == taxon, F.col("share"))), F.lit(0.0)).alias("sort_value"))
    else:
        keys = metadata.select("sample_id", F.col(column).alias("sort_value"))
    order = F.col("sort_value").desc() if descending else F.col("sort_value").asc()
    return shares.join(keys, "sample_id", "left").orderBy(order, "sample_id", "taxon")


def top_taxa(collapsed: DataFrame, k: int, other: str = "other") -> DataFrame:
    """Counts of the ``k`` largest taxa; all others are summed as ``other``."""
    totals = collapsed.groupBy("taxon").agg(F.sum("frequency").alias("_total"))
    top = totals.orderBy(F.col("_total").desc(), "taxon").limit(k).select("taxon", F.lit(True).alias("_top"))
    # The broadcast side has k rows.
    named = collapsed.join(F.broadcast(top), "taxon", "left").withColumn(
        "taxon", F.when(F.col("_top"), F.col("taxon")).otherwise(F.lit(other)))
    return named.groupBy("taxon", "sample_id").agg(F.sum("frequency").alias("frequency"))


def barplot_table(ft: DataFrame, taxonomy: DataFrame, metadata: DataFrame, level: int,
                  taxa: list[str] | None = None, check: bool = True, missing: str = "error") -> DataFrame:
    """Shares per sample and taxon with the metadata columns.

    With ``taxa`` (the columns wanted) one row per sample, else the long form.
    """
    shares = relative_abundance(collapse_taxa(ft, taxonomy, level, missing=missing))
    if taxa is not None:
        shares = to_wide(shares, taxa, row="sample_id", column="taxon", value="share")
    return attach_metadata(shares, metadata, check)


def barplot_all_levels(ft: DataFrame, taxonomy: DataFrame, metadata: DataFrame, max_level: int = 7,
                       check: bool = True, missing: str = "error") -> DataFrame:
    """The table behind a plot that offers every rank: ``level, sample_id, taxon, frequency, share`` with the
    metadata columns. Counts are collapsed to all ranks in one pass; shares add up to one per rank and sample.

    Every count is in one taxon of each rank, so a sample has one total for all ranks. It is added up, and joined
    with the metadata, where the sample's counts lie already.
    """
    if check:
        require_metadata(ft if missing == "error" else semi_keep(ft, taxonomy), metadata)
    by_sample = _by_sample(ft, taxonomy, max_level, "__", missing).filter(F.col("sample_id").isNotNull())
    with_total = by_sample.withColumn("_total", F.sum("frequency").over(Window.partitionBy("sample_id")))
    # The hashed side has a row per sample.
    shares = _every_level(with_total, max_level, "_total").join(
        one_row_per(metadata, "sample_id", "metadata").hint("shuffle_hash"), "sample_id", "left")
    share = F.when(F.col("_total") != 0, F.col("frequency") / F.col("_total"))
    return shares.select("level", "sample_id", "taxon", "frequency", share.alias("share"),
                         *[shares[f"`{c}`"] for c in metadata.columns if c != "sample_id"])


def empty_samples(ft: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata samples without any count."""
    return metadata.select("sample_id").join(
        ft.filter(F.col("frequency") > 0).select("sample_id").distinct(), "sample_id", "left_anti")
