import random

from pyspark.sql import functions as F

from ampliframe.operators import reads as rd

PAIR = "sample_id string, read_no long, fwd string, fwd_qual string, rev string, rev_qual string"


def pairs(spark, *rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], PAIR)


def test_trim_and_length(spark):
    df = pairs(spark, ("ACGTACGT", "ABCDEFGH", "TTTTAAAA", "ABCDEFGH"), ("ACGTACG", "ABCDEFG", "TTTTAAAA", "ABCDEFGH"))
    out = rd.trim_truncate(df, 2, 3, 8, 6).collect()
    assert [tuple(r)[2:] for r in out] == [("GTACGT", "CDEFGH", "TAA", "DEF")]


def test_quality_cut(spark):
    df = pairs(spark, ("ACGT", "II#I", "ACGT", "IIII"))
    assert tuple(rd.truncate_at_quality(df).first())[2:] == ("AC", "II", "ACGT", "IIII")


def test_expected_errors_and_n(spark):
    df = pairs(spark, ("AC", "II", "AC", "II"), ("AN", "II", "AC", "II"), ("AC", "!!", "AC", "II"), ("AC", "!I", "AC", "II"))
    assert [r.read_no for r in rd.filter_expected_errors(df, 1.5, 1.5).collect()] == [0, 3]
    assert [r.read_no for r in rd.filter_expected_errors(df, 1.5, 1.5, max_n=1).collect()] == [0, 1, 3]


def test_dereplicate_means(spark):
    reads = spark.createDataFrame(
        [("s", "F", "ACGT" * 9, "I" * 36), ("s", "F", "ACGT" * 9, "5" * 35 + "!"), ("s", "F", "AC", "+I"), ("s", "R", "AC", "+I")],
        "sample_id string, direction string, seq string, qual string")
    got = {(r.direction, r.sequence): (r.n, r.mean_quality) for r in rd.dereplicate(reads).collect()}
    assert got["F", "ACGT" * 9] == (2, [30.0] * 35 + [20.0])
    assert got["F", "AC"] == got["R", "AC"] == (1, [10.0, 40.0])
    text = {r.sequence: r.quality for r in rd.rounded_quality(rd.dereplicate(reads)).collect()}
    assert text["ACGT" * 9] == "?" * 35 + "5" and text["AC"] == "+I"


def test_contaminants(spark):
    genome = "ACGTTGCAAGCTTGACCGAT"
    df = pairs(spark, (genome[:17], "I", "A" * 20, "I"), (genome[:16], "I", "A" * 20, "I"), ("C" * 20, "I", genome[3:], "I"))
    contaminants = spark.createDataFrame([(genome,)], "sequence string")
    assert [r.read_no for r in rd.remove_contaminants(df, contaminants, ["sample_id", "read_no"]).collect()] == [1]


def test_seven_numbers_of_a_subsample(spark):
    reads = spark.range(200).select(F.lit("s").alias("sample_id"), F.lit("F").alias("direction"),
                                    F.col("id").alias("read_no"), F.lit("AC").alias("seq"), F.lit("+I").alias("qual"))
    got = rd.quality_by_position(reads, n=50, seed=1).orderBy("position").collect()
    assert [(r.position, r.n, r.p50) for r in got] == [(1, 50, 10.0), (2, 50, 40.0)]


def test_contaminants_by_map_equal_the_join(spark, rows):
    rng = random.Random(5)
    make = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    genomes = [make(300), make(200) + "N" + make(50), make(10)]
    some = []
    for i in range(300):
        at = rng.randrange(180)
        fwd = genomes[i % 2][at:at + rng.choice([15, 16, 17, 40])] + make(rng.randrange(30), "ACGTN") if i % 3 else make(60)
        some.append((fwd, "I", make(40) if i % 5 else fwd[::-1], "I"))
    some += [("", "", "", ""), ("ACG", "I", "N" * 40, "I"), (None, None, make(50), "I")]
    df, dirt = pairs(spark, *some), spark.createDataFrame([(g,) for g in genomes], "sequence string")
    words = {g[i:i + 16] for g in genomes for i in range(len(g) - 15) if "N" not in g[i:i + 16]}
    expected = [i for i, (f, _, r, _) in enumerate(some)
                if len({x[j:j + 16] for x in (f or "", r or "") for j in range(len(x) - 15)} & words) < 2]
    for limit in (10 ** 6, 0):
        out = rd.remove_contaminants(df, dirt, ["sample_id", "read_no"], max_words=limit)
        assert sorted(r.read_no for r in out.collect()) == expected and out.columns == df.columns
    assert 50 < len(expected) < 300
    none = rd.remove_contaminants(df, dirt.limit(0), ["sample_id", "read_no"])
    assert none.count() == len(some)
    plan = rd.remove_contaminants(df, dirt, ["sample_id", "read_no"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_batches_are_summed_before_the_shuffle(spark):
    """Many copies of few sequences: a task hands on one row per sequence and chunk, not one per read."""
    from ampliframe.operators import reads as rd
    rows = spark.range(4000).selectExpr("'s' AS sample_id", "'F' AS direction", "repeat(substr('ACGT', cast(id % 4 AS int) + 1, 1), 20) AS seq",
                                        "repeat(char(cast(id % 3 + 40 AS int)), 20) AS qual").coalesce(1)
    partly = rows.mapInArrow(rd._summed_qualities, "sample_id string, direction string, seq string, n long, sums array<long>")
    assert partly.count() == 4
    got = rd.dereplicate(rows.repartition(3)).collect()
    assert {r.sequence[0] for r in got} == set("ACGT") and all(r.n == 1000 and len(r.mean_quality) == 20 for r in got)
    want = {c: sum(i % 3 + 7 for i in range(4000) if i % 4 == "ACGT".index(c)) / 1000 for c in "ACGT"}
    assert all(abs(q - want[r.sequence[0]]) < 1e-9 for r in got for q in r.mean_quality)
