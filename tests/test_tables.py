import math
import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliframe.operators import lookup, reads as rd, reshape, table as tb, taxa as tx
from ampliframe.operators.partitioning import global_index, number_rows, salted_join, weighted_quantiles


@pytest.fixture(scope="module")
def ft(spark):
    """One sample holds a third of all rows."""
    return spark.range(3000).select(
        F.concat(F.lit("f"), (F.col("id") % 997).cast("string")).alias("feature_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("sample_id"),
        (F.col("id") % 13 + 1).alias("frequency")).groupBy("feature_id", "sample_id").agg(F.sum("frequency").alias("frequency"))


@pytest.fixture(scope="module")
def tax(spark):
    return spark.range(997).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("feature_id"),
        F.concat(F.lit("D_0__B;D_1__"), (F.col("id") % 5).cast("string"),
                 F.when(F.col("id") % 2 == 0, F.lit(";D_2__x")).otherwise(F.lit(""))).alias("taxon"))


def total(df):
    return df.agg(F.sum("frequency")).first()[0]


def test_counts_are_conserved(ft, tax):
    assert total(tx.collapse_taxa(ft, tax, 2)) == total(ft)
    levels = tx.collapse_all_levels(ft, tax)
    assert {r.level: r["sum(frequency)"] for r in levels.groupBy("level").sum("frequency").collect()} == {
        level: total(ft) for level in (1, 2, 3)}
    assert total(tx.top_taxa(tx.collapse_taxa(ft, tax, 3), 2)) == total(ft)


def test_wide_and_back(ft, rows):
    samples = sorted(r.sample_id for r in ft.select("sample_id").distinct().collect())
    assert rows(reshape.to_long(reshape.to_wide(ft, samples)).select(ft.columns)) == rows(ft)


def test_shares_sum_to_one(ft):
    sums = tx.relative_abundance(ft).groupBy("sample_id").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums) and len(sums) == 8


def test_results_do_not_depend_on_partitions(spark, ft, tax, rows):
    def run():
        shares = tx.relative_abundance(tx.collapse_all_levels(ft, tax), ["level", "sample_id"])
        return rows(shares.withColumn("share", F.round("share", 9)))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(run())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_missing_taxonomy_is_an_error_or_dropped(ft, tax):
    part = tax.filter("feature_id != 'f5'")
    with pytest.raises(ValueError, match="f5"):
        tx.filter_table_by_taxon(ft, part, "D_")
    kept = tx.filter_table_by_taxon(ft, part, "D_", missing="drop")
    assert kept.filter("feature_id = 'f5'").count() == 0 and total(kept) < total(ft)


def test_metadata_join(spark, ft):
    per_sample = tb.frequency_per_sample(ft)
    ids = per_sample.select("sample_id").withColumn("site", F.lit("x"))
    extra = ids.union(spark.createDataFrame([("unknown", "y")], ids.schema))
    assert lookup.attach_metadata(per_sample, extra).count() == per_sample.count()
    with pytest.raises(ValueError, match="hot"):
        lookup.attach_metadata(per_sample, extra.filter("sample_id != 'hot'"))
    assert [r.sample_id for r in tx.empty_samples(ft, extra).collect()] == ["unknown"]


def test_lookup_takes_the_first_match_and_keeps_every_row(spark, rows):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "k string, x int")
    right = spark.createDataFrame([("a", "late", 2), ("a", "early", 1), (None, "null", 3), ("b", None, 1), ("b", "v", 2)],
                                  "key string, v string, o int")
    found = lookup.match_lookup(left, right, "k", "key", "v", ["o"], name="t")
    assert rows(found) == rows(spark.createDataFrame(
        [("a", 1, "early"), ("a", 4, "early"), ("b", 2, None), (None, 3, "null")], "k string, x int, t string"))


def test_strip_quotes(spark):
    df = spark.createDataFrame([('a"b""', 1)], "t string, n int")
    assert tuple(lookup.strip_quotes(df).first()) == ("ab", 1)
    assert lookup.column_names(df) == ["t", "n"]


def test_retention(ft):
    kept = {r.depth: (r.samples_kept, r.counts_kept) for r in tb.retention_at_depth(ft, [1, 2000, 10**9]).collect()}
    deep = tb.frequency_per_sample(ft).filter("frequency >= 2000").count()
    assert kept == {1: (8, 8), 2000: (deep, 2000 * deep), 10**9: (0, 0)}


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "read_no")
    everything = df.select("read_no", F.md5(F.concat_ws("|", F.col("read_no").cast("string"), F.lit("3"))).alias("h"))
    for n in (1, 10, 1234, 4999, 5000, 6000):
        expected = sorted(r.read_no for r in everything.orderBy("h").limit(n).collect())
        for parts in (1, 7):
            got = rd.sample_reads(df.repartition(parts), n, 3, ["read_no"])
            assert sorted(r.read_no for r in got.collect()) == expected


def test_global_index_has_no_gaps(spark):
    df = spark.range(1000).select(F.format_string("%05d", F.col("id") * 7 % 1009).alias("k")).repartition(6)
    numbered = global_index(df, ["k"], "n").orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(1000))
    assert [r.k for r in numbered] == sorted(r.k for r in numbered)
    assert global_index(df.limit(0), ["k"], "n").count() == 0


def test_salted_join_equals_join(spark, rows):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert rows(salted_join(big, small, ["k"], 5)) == rows(big.join(small, "k"))


def test_quantiles_equal_numpy(spark):
    values = [int(v) for v in np.random.default_rng(0).integers(-20, 60, 777)] + [10 ** 12, 10 ** 12 + 1]
    counted = spark.createDataFrame([(v,) for v in values], "v long").groupBy("v").count().repartition(5)
    fractions = {"a": 0.0, "b": 0.25, "c": 0.33, "d": 0.5, "e": 0.75, "f": 1.0}
    got = weighted_quantiles(counted, "v", "count", fractions).collect()
    assert len(got) == 1 and np.allclose(tuple(got[0]), np.quantile(values, list(fractions.values())))
    assert [tuple(r) for r in weighted_quantiles(counted.limit(0), "v", "count", {"m": 0.5}).collect()] == [(None,)]
    grouped = counted.withColumn("g", F.col("v") % 2)
    for row in weighted_quantiles(grouped, "v", "count", fractions, ["g"]).collect():
        own = [v for v in values if math.fmod(v, 2) == row.g]
        assert np.allclose(tuple(row)[1:], np.quantile(own, list(fractions.values())))


def test_quantiles_start_no_job(spark, ft):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    tb.frequency_quantiles(tb.frequency_per_feature(ft))
    reads = spark.createDataFrame([("s", "F"), ("s", "R")], "sample_id string, direction string")
    rd.demux_count_summary(reads)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_rows_are_numbered_as_they_stand(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k")).repartition(4).orderBy(F.col("k").desc())
    assert {r.k: r.place for r in number_rows(df, "place").collect()} == {99 - i: i for i in range(100)}


def test_empty_table(spark, ft):
    none = ft.filter("frequency < 0")
    assert tuple(tb.table_overview(none).first()) == (0, 0, 0)
    assert tx.relative_abundance(none).count() == 0
