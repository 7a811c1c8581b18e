from pyspark.sql import functions as F

from ampliframe import functions as fn
from ampliframe.operators import taxa as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_reverse_complement_twice_is_identity(spark):
    assert one(spark, fn.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    assert one(spark, fn.reverse_complement(fn.reverse_complement(F.lit("AACGN")))) == "AACGN"


def test_phred_and_expected_errors(spark):
    assert one(spark, fn.phred(F.lit("!+5?I"))) == [0, 10, 20, 30, 40]
    assert abs(one(spark, fn.expected_errors(F.lit("+5"))) - 0.11) < 1e-12


def test_quality_prefix(spark):
    assert one(spark, fn.quality_prefix_length(F.lit("II#I"), 2)) == 2
    assert one(spark, fn.quality_prefix_length(F.lit("#III"), 2)) == 0
    for q in range(0, 94):  # every threshold, also those whose character means something in a pattern
        text = chr(33 + q) if q == 93 else chr(34 + q) + chr(33 + q)
        assert one(spark, fn.quality_prefix_length(F.lit(text), q)) == (0 if q == 93 else 1), q


def test_kmers(spark):
    assert one(spark, fn.kmers(F.lit("ACGTA"), 3)) == ["ACG", "CGT", "GTA"]
    assert one(spark, fn.kmers(F.lit("ACG"), 3)) == ["ACG"]
    assert one(spark, fn.kmers(F.lit("AC"), 3)) == []


def test_hamming(spark):
    assert one(spark, fn.mismatches(F.lit("ACGT"), F.lit("TCGA"))) == [0, 3]
    assert one(spark, fn.hamming(F.lit("ACGT"), F.lit("ACGT"))) == 0


def test_lineages(spark):
    assert one(spark, fn.split_taxonomy(F.lit("D_0__A; D_1__B"))) == ["D_0__A", "D_1__B"]
    assert tuple(one(spark, fn.rank_of(F.lit("D_4__Mitochondria")))) == (4, "Mitochondria")
    assert tuple(one(spark, fn.rank_of(F.lit("Unassigned")))) == (None, None)
    assert one(spark, fn.lineage_prefix(F.lit("a;b;c"), 2)) == "a;b"
    assert one(spark, fn.lineage_prefix(F.lit("a"), 3)) == "a;__;__"
    assert fn.parse_terms(" a, b ,,c") == ["a", "b", "c"] and fn.parse_terms(None) == []


def test_filter_terms_are_literal_text(spark):
    tax = spark.createDataFrame([
        ("1", "D_0__Bacteria;D_4__Mitochondria"), ("2", "uncultured bacterium"),
        ("3", "D_0__Bacteria;D_3__Chloroplast"), ("4", "d_0__bacteria")], "feature_id string, taxon string")

    def kept(**terms):
        return sorted(r.feature_id for r in tx.keep_features(tax, **terms).collect())

    assert kept(include="D_") == ["1", "3", "4"]  # the underscore is no wildcard
    assert kept(include="D_", exclude="Mitochondra,Chloroplast") == ["1", "4"]  # misspelt: stays in
    assert kept(include="D_", exclude="D_4__Mitochondria") == ["3", "4"]
    assert kept(exclude="D_0__Bacteria", mode="exact") == ["1", "2", "3"]
    assert kept() == ["1", "2", "3", "4"]


def test_hamming_of_long_and_odd_sequences(spark):
    from ampliframe.functions import hamming
    a = "ACGT" * 25
    pairs = [(a, a, 0), (a, "T" + a[1:-1] + "A", 2), (a, a.translate(str.maketrans("ACGT", "CGTA")), 100), ("", "", 0), ("AC", "AG", 1),
             (a[:21], a[:20] + "C", 1), (None, "A", None)]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(pairs)], "i int, a string, b string")
    found = {r.i: r.d for r in rows.select("i", hamming(F.col("a"), F.col("b")).alias("d")).collect()}
    assert found == {i: d for i, (_, _, d) in enumerate(pairs)}
