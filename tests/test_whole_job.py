"""Registered queries that once did less than their whole job, and inputs that grow in parts."""

import duckdb
import pytest

from ampliframe.operators import taxa as tx
from ampliframe.operators.partitioning import spread
from ampliframe.plans import queries as registered

from test_queries import SF, TABLES, pytestmark  # noqa: F401


def test_a_sample_with_any_organelle_count_is_not_empty(spark):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    # Mitochondria are the parts divisible by 17 that no earlier rule names.
    full = {str(r[0]) for r in duck.execute("""SELECT DISTINCT l_suppkey FROM lineitem
        WHERE l_partkey % 17 = 0 AND l_partkey % 19 <> 0 AND l_partkey % 23 <> 0""").fetchall()}
    every = {str(r[0]) for r in duck.execute("SELECT s_suppkey FROM supplier").fetchall()}
    assert {r.sample_id for r in registered.QUERIES["empty_samples"](spark, SF).collect()} == every - full


def test_taxonomy_model_states_its_counts(spark):
    assert "n" in registered.QUERIES["train_taxonomy_nb"](spark, SF).columns


@pytest.mark.parametrize("rows, parts", [(10, 4), (1000, 10)])
def test_parts_grow_with_the_rows(spark, rows, parts):
    assert spread(spark.range(rows).coalesce(1), 100, "id").rdd.getNumPartitions() == parts


@pytest.fixture
def plot_inputs(spark):
    counts = [(f"f{i % 50}", f"s{i % 7}", 1 + i % 5) for i in range(1000)] + [("f1", None, 3)]
    lineages = [(f"f{i}", f"D_0__A; D_1__{i % 3}" + (f";D_2__{i % 10}" if i % 2 else "")) for i in range(50)]
    return (spark.createDataFrame(counts, "feature_id string, sample_id string, frequency long"),
            spark.createDataFrame(lineages, "feature_id string, taxon string"),
            spark.createDataFrame([(f"s{i}", i) for i in range(7)], "sample_id string, depth int"), counts, dict(lineages))


@pytest.mark.parametrize("job", ["collapse_taxa", "collapse_all_levels", "barplot_all_levels"])
def test_parts_of_collapsed_counts_grow_with_the_table(plot_inputs, monkeypatch, job):
    monkeypatch.setattr(tx, "COUNTS_PER_PART", 50)
    ft, tax, meta, _, _ = plot_inputs
    run = {"collapse_taxa": lambda: tx.collapse_taxa(ft, tax, 2), "collapse_all_levels": lambda: tx.collapse_all_levels(ft, tax),
           "barplot_all_levels": lambda: tx.barplot_all_levels(ft, tax, meta, 3, check=False)}[job]
    assert run().rdd.getNumPartitions() == 21


def test_plot_table_equals_a_plain_count(plot_inputs):
    ft, tax, meta, counts, lineages = plot_inputs
    want, totals = {}, {}
    for feature, sample, n in counts:
        ranks = [x.strip() for x in lineages[feature].split(";")] + ["__"] * 4
        totals[sample] = totals.get(sample, 0) + n
        for level in range(1, 5):
            key = (level, sample, ";".join(ranks[:level]))
            want[key] = want.get(key, 0) + n
    collapsed = {(r.level, r.sample_id, r.taxon): r.frequency for r in tx.collapse_all_levels(ft, tax, 4).collect()}
    assert collapsed == want
    plot = tx.barplot_all_levels(ft, tax, meta, 4, check=False)
    assert plot.columns == ["level", "sample_id", "taxon", "frequency", "share", "depth"]
    assert {(r.level, r.sample_id, r.taxon): (r.frequency, r.share, r.depth) for r in plot.collect()} == {
        k: (n, n / totals[k[1]], int(k[1][1:])) for k, n in want.items() if k[1] is not None}
    with pytest.raises(ValueError, match="samples without metadata"):
        tx.barplot_all_levels(ft, tax, meta, 4)
