"""Results that must not lose rows, whatever the fixtures hold."""

import pytest

from ampliframe.operators import align, classify, errors, reads, reshape, table as tb, taxa as tx
from pyspark.sql import functions as F


@pytest.fixture
def counts(spark):
    return spark.createDataFrame([("f1", "a", 5), ("f2", "a", 15), ("f2", "b", 7)], "feature_id string, sample_id string, frequency long")


@pytest.fixture
def half(spark):
    return spark.createDataFrame([("f1", "D_0__X;D_1__Y")], "feature_id string, taxon string")


@pytest.mark.parametrize("collapse", [lambda f, t, **k: tx.collapse_taxa(f, t, 1, **k), lambda f, t, **k: tx.collapse_all_levels(f, t, 2, **k)])
def test_missing_taxonomy_is_an_error_or_dropped(counts, half, collapse):
    with pytest.raises(Exception, match="without taxonomy"):
        collapse(counts, half).collect()
    assert {r.sample_id for r in collapse(counts, half, missing="drop").collect()} == {"a"}


def test_rows_without_a_wanted_column_are_zero(spark, counts):
    wide = {r.feature_id: (r.b, r.c) for r in reshape.to_wide(counts, ["b", "c"]).collect()}
    assert wide == {"f1": (0, 0), "f2": (7, 0)}
    tax = spark.createDataFrame([("f1", "D_0__X"), ("f2", "D_0__Z")], "feature_id string, taxon string")
    meta = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, m int")
    shares = {r.sample_id: r["D_0__X"] for r in tx.barplot_table(counts, tax, meta, 1, ["D_0__X"]).collect()}
    assert shares == {"a": 0.25, "b": 0.0}


def test_depths_that_nobody_reaches(counts):
    kept = {r.depth: (r.samples_kept, r.counts_kept) for r in tb.retention_at_depth(counts, [1, 10, 100]).collect()}
    assert kept == {1: (2, 2), 10: (1, 10), 100: (0, 0)}


def test_short_sequences_keep_a_row(spark):
    seqs = spark.createDataFrame([("s", "ACG"), ("l", "ACGTACGTAC")], "feature_id string, sequence string")
    assert {r.feature_id: r.distance for r in align.kmer_distance(seqs, "ACGTACGTAC").collect()} == {"s": None, "l": 0.0}


def test_contaminants_of_one_lane_leave_the_other(spark):
    bad, good = "ACGTTGCAACGTGGTTCCAATTGGCCAATG", "TTTTTTTTTTCCCCCCCCCCAAAAAAAAAAG"
    pairs = spark.createDataFrame([("s", 1, 2, bad, bad), ("s", 2, 2, good, good)], "sample_id string, lane int, read_no long, fwd string, rev string")
    dirt = spark.createDataFrame([(bad,)], "sequence string")
    left = reads.remove_contaminants(pairs, dirt, ["sample_id", "lane", "read_no"])
    assert [r.lane for r in left.collect()] == [2]


def test_posterior_is_over_all_taxa(spark):
    import math
    import random
    make = random.Random(1)
    refs = [(f"t{i:04d}", "".join(make.choice("ACGT") for _ in range(30))) for i in range(300)]
    model = classify.train_taxonomy_nb(spark.createDataFrame(refs, "taxon string, sequence string"), k=6, alpha=0.5)
    query = refs[0][1][:7] + "".join(make.choice("ACGT") for _ in range(6))
    words = [query[i:i + 6] for i in range(len(query) - 5)]
    score = {}
    for name, seq in refs:
        have = [seq[i:i + 6] for i in range(25)]
        score[name] = sum(math.log((have.count(w) + 0.5) / (25 + 0.5 * 4 ** 6)) for w in words)
    total = sum(math.exp(s) for s in score.values())
    best = max(score, key=score.get)
    found = classify.classify_nb(spark.createDataFrame([("q", query)], "feature_id string, sequence string"), model).first()
    assert found.taxon == best and found.confidence == pytest.approx(math.exp(score[best]) / total)


def test_other_letters_say_nothing(spark):
    rates = errors.log_rate_table(errors.nominal_rates(spark))
    row = spark.createDataFrame([("ACGT", "ANGT", "IIII"), ("ACGT", "AGT", "III")][:1], "c string, s string, q string")
    base = spark.createDataFrame([("AGT", "AGT", "III")], "c string, s string, q string")
    one, two = (f.select(errors.log_likelihood(F.col("c"), F.col("s"), F.col("q"), rates)).first()[0] for f in (row, base))
    assert one == pytest.approx(two)
