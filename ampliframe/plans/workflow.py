"""The whole analysis: reads to counts, counts to filtered composition, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ampliframe.operators import denoise as dn
from ampliframe.operators.classify import TaxonomyModel, assign_taxonomy
from ampliframe.operators.lookup import match_lookup, semi_keep
from ampliframe.operators.reads import (
    by_direction, dereplicate, filter_expected_errors, remove_contaminants, require_sound, rounded_quality,
    sample_reads, trim_truncate, truncate_at_quality)
from ampliframe.operators.taxa import (
    collapse_taxa, filter_taxonomy, relative_abundance, require_taxonomy)
from ampliframe.sources.sinks import TSV_COMMENT, write_table
from ampliframe.sources.stage import persist_stage

# The terms of the two filter passes. The first one misspells mitochondria, so
# only the second removes them.
INCLUDE = "D_"
EXCLUDE_FIRST = "Archaea,Mitochondra,Chloroplast,Unassigned"
EXCLUDE_SECOND = "D_4__Mitochondria"


@dataclass
class Counts:
    table: DataFrame       # feature_id, sample_id, frequency
    sequences: DataFrame   # feature_id, sequence
    stats: DataFrame       # reads per sample after each step


def filter_reads(pairs: DataFrame, trim_f: int = 23, trim_r: int = 20, trunc_f: int = 200,
                 trunc_r: int = 200, trunc_q: int = 2, max_ee: float = 2.0) -> DataFrame:
    cut = trim_truncate(truncate_at_quality(pairs, trunc_q), trim_f, trim_r, trunc_f, trunc_r)
    return filter_expected_errors(cut, max_ee, max_ee)


def reads_to_counts(pairs: DataFrame, contaminants: DataFrame | None = None, key: list[str] | None = None,
                    learn_from: int | None = None, omega: float = 1e-40, d_max: int = 6,
                    min_overlap: int = 12, max_iter: int | None = None, rates: DataFrame | None = None, **trimming) -> Counts:
    """Paired reads to a chimera-free count table. An unsound pair stops the job.

    ``rates`` are error rates to be used as they are. Without them all fragments train the rates, or ``learn_from`` of them (chosen by hash) if a number
    is given. ``key`` names a fragment; the lane is part of it where there is one, since reads are
    numbered per file.
    """
    key = key or [c for c in ("sample_id", "lane", "read_no") if c in pairs.columns]
    pairs = require_sound(pairs)
    kept = filter_reads(pairs, **trimming)
    if contaminants is not None:
        kept = remove_contaminants(kept, contaminants, key)
    kept = persist_stage(kept.select(*key, "fwd", "fwd_qual", "rev", "rev_qual"), "filtered")
    uniques = persist_stage(rounded_quality(dereplicate(by_direction(kept))), "uniques")
    if rates is None:
        training = uniques
        if learn_from is not None and kept.count() > learn_from:
            training = persist_stage(rounded_quality(dereplicate(by_direction(
                sample_reads(kept, learn_from, 0, key)))), "training")
        rates = dn.learn_error_model(training, max_iter, omega, d_max)
    assigned = persist_stage(dn.denoise(uniques, rates, omega, d_max), "assigned")
    centre_pairs = persist_stage(dn.pairs_of_centres(dn.count_pairs(kept), assigned), "centre-pairs")
    merged = persist_stage(dn.merge_pairs(centre_pairs, min_overlap), "merged")
    chimeras = dn.consensus_bimeras(dn.flag_bimeras(merged))
    clean = persist_stage(dn.remove_bimeras(merged, chimeras), "clean")

    def per_sample(df: DataFrame) -> DataFrame:
        return df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))

    stats = dn.denoise_stats(input=per_sample(pairs), filtered=per_sample(kept), denoised=centre_pairs,
                             merged=merged, non_chimeric=clean)
    return Counts(dn.make_feature_table(clean), dn.rep_seqs(clean), stats)


def organelle_free(taxonomy: DataFrame) -> DataFrame:
    """Both filter passes as one condition on the lineages; counts and sequences share it."""
    return filter_taxonomy(filter_taxonomy(taxonomy, INCLUDE, EXCLUDE_FIRST), INCLUDE, EXCLUDE_SECOND)


def remove_organelles(features: DataFrame, taxonomy: DataFrame, missing: str = "error") -> DataFrame:
    """Counts, or sequences, without the features that either filter pass removes."""
    if missing == "error":
        require_taxonomy(features, taxonomy)
    return semi_keep(features, organelle_free(taxonomy))


def composition(ft: DataFrame, taxonomy: DataFrame, level: int = 2, missing: str = "error") -> DataFrame:
    """Share of each taxon in each sample after the two filter passes.

    Joining the filtered lineages filters the counts too, so one join does both.
    """
    if missing == "error":
        require_taxonomy(ft, taxonomy)
    return relative_abundance(collapse_taxa(ft, organelle_free(taxonomy), level, missing="drop"))


def classify_counts(counts: Counts, model: TaxonomyModel, confidence: float = 0.7) -> DataFrame:
    return assign_taxonomy(counts.sequences, model, confidence, orientation="auto")


def export_with_taxonomy(wide: DataFrame, taxonomy: DataFrame, path: str, id_col: str = "#OTU ID") -> None:
    """Wide counts with a looked-up ``taxonomy`` column as text: comment line, no quotes."""
    named = match_lookup(wide, taxonomy, id_col, "feature_id", "taxon", ["taxon"], name="taxonomy")
    write_table(named, path, order_by=[id_col], quote=False, comment=TSV_COMMENT)
