from ampliframe.functions.sequence import (  # noqa: F401
    expected_errors, feature_id, hamming, kmers, let, mismatches, phred,
    quality_prefix_length, reverse_complement)
from ampliframe.functions.taxonomy import (  # noqa: F401
    lineage_prefix, matches_any, parse_terms, rank_of, split_taxonomy)
