import math
import random

import pytest
from pyspark.sql import functions as F

from ampliframe.operators import denoise as dn, errors, near
from ampliframe.plans.workflow import reads_to_counts

UNIQUE = "sample_id string, direction string, sequence string, n long, quality string"


def mutate(rng, seq, places):
    seq = list(seq)
    for p in rng.sample(range(len(seq)), places):
        seq[p] = rng.choice([b for b in "ACGT" if b != seq[p]])
    return "".join(seq)


def random_uniques(seed, length=40):
    """Two samples; one hot template with many near copies, some close true variants."""
    rng, found = random.Random(seed), {}
    for sample in ("s1", "s2"):
        for direction in "FR":
            for t in range(4):
                base = "".join(rng.choice("ACGT") for _ in range(length))
                found[sample, direction, base] = 400 if t == 0 else rng.randint(2, 60)
                for _ in range(40 if t == 0 else 8):
                    copy = mutate(rng, base, rng.choice([1, 1, 1, 2, 3, 5, 7]))
                    found.setdefault((sample, direction, copy), rng.choice([1, 1, 1, 2, 2, 3, 9, 45]))
    return [(*key, n, "".join(rng.choice("5?DI") for _ in range(length))) for key, n in found.items()]


def log_tail(n, mean):
    if n <= 1 or n <= mean:
        return 0.0
    terms = [-mean + k * math.log(mean) - math.lgamma(k + 1) for k in range(n, n + 200)]
    top = max(terms)
    value = top + math.log(sum(math.exp(x - top) for x in terms))
    return min(value - (math.log(mean) if mean < 1e-8 else math.log(-math.expm1(-mean))), 0.0)


def nominal(a, b, q):
    wrong = min(10 ** (-q / 10), 0.75)
    return 1 - wrong if a == b else wrong / 3


def brute_force(uniques, omega, d_max, rate=nominal):
    groups = {}
    for sample, direction, seq, n, qual in uniques:
        groups.setdefault((sample, direction), []).append((seq, n, qual))
    result = {}
    for group, members in groups.items():
        members.sort(key=lambda m: (-m[1], m[0]))
        centres = []
        bar = math.log(omega) - math.log(len(members))

        def explaining(seq, n, qual, pool):
            for c, cn in pool:
                if not (cn > n or (cn == n and c < seq)) or sum(a != b for a, b in zip(c, seq)) > d_max:
                    continue
                lm = math.log(cn) + sum(math.log(rate(a, b, ord(q) - 33)) for a, b, q in zip(c, seq, qual))
                if log_tail(n, math.exp(lm)) >= bar:
                    yield -lm, c

        for seq, n, qual in members:
            if n >= 2 and not any(True for _ in explaining(seq, n, qual, centres)):
                centres.append((seq, n))
        own = {c for c, _ in centres}
        for seq, n, qual in members:
            best = min(explaining(seq, n, qual, centres), default=None)
            if seq in own:
                result[(*group, seq)] = seq
            elif best:
                result[(*group, seq)] = best[1]
    return result


@pytest.mark.parametrize("seed,omega,d_max", [(1, 1e-40, 6), (2, 1e-10, 3), (3, 1e-4, 1)])
def test_denoise_equals_brute_force(spark, seed, omega, d_max):
    uniques = random_uniques(seed)
    got = dn.denoise(spark.createDataFrame(uniques, UNIQUE), errors.nominal_rates(spark), omega, d_max)
    got = {(r.sample_id, r.direction, r.sequence): r.centre for r in got.collect()}
    expected = brute_force(uniques, omega, d_max)
    assert got == expected
    assert 0 < len(set(expected.values())) < len(expected) <= len(uniques)


@pytest.mark.parametrize("seed", [7, 8])
def test_learned_rates_equal_brute_force(spark, seed):
    uniques, omega, d_max, top = random_uniques(seed), 1e-6, 4, 45
    rate, last = nominal, None
    for _ in range(10):
        assigned = brute_force(uniques, omega, d_max, rate)
        if assigned == last:
            break
        last, counts = assigned, {}
        for s, d, seq, n, qual in uniques:
            centre = assigned.get((s, d, seq))
            for a, b, q in zip(centre or "", seq, qual):
                counts[a, b, ord(q) - 33] = counts.get((a, b, ord(q) - 33), 0) + n
        smooth = {(a, b, q): 1 + sum(counts.get((a, b, p), 0) for p in range(q - 2, q + 3))
                  for a in "ACGT" for b in "ACGT" for q in range(top + 1)}
        table = {(a, b, q): v / sum(smooth[a, x, q] for x in "ACGT") for (a, b, q), v in smooth.items()}
        rate = lambda a, b, q, table=table: table[a, b, q]
    got = dn.learn_error_model(spark.createDataFrame(uniques, UNIQUE), 10, omega, d_max, top)
    for r in got.collect():
        assert abs(r.rate - rate(r.from_base, r.to_base, r.q)) < 1e-12


def test_near_pairs_equal_brute_force(spark):
    uniques = random_uniques(5, 23)
    df = spark.createDataFrame(uniques, UNIQUE)
    centres = df.filter("n > 20").select("sample_id", "direction", F.col("sequence").alias("centre"))
    got = sorted((r.sample_id, r.direction, r.sequence, r.centre, r.distance)
                 for r in near.near_pairs(df, centres, 4).collect())
    expected = sorted((s, d, a, b, sum(x != y for x, y in zip(a, b))) for s, d, a, _, _ in uniques
                      for s2, d2, b, n, _ in uniques if (s, d) == (s2, d2) and n > 20
                      and sum(x != y for x, y in zip(a, b)) <= 4)
    assert got == expected  # and no pair twice


def test_planted_variants(spark):
    rng = random.Random(0)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    rare = [mutate(rng, base, 1) for _ in range(3)]
    true = mutate(rng, base, 1)
    uniques = [("s", "F", base, 200, "?" * 60), ("s", "F", true, 90, "I" * 60)] + [("s", "F", r, 2, "?" * 60) for r in rare]
    df = spark.createDataFrame(uniques, UNIQUE)
    rates = dn.learn_error_model(df, max_iter=4)
    assert rates.count() == 16 * 46
    sums = rates.groupBy("from_base", "q").agg(F.sum("rate").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    got = {r.sequence: r.centre for r in dn.denoise(df, rates).collect()}
    assert got == {base: base, true: true, **{r: base for r in rare}}


def test_surplus_chance(spark):
    for n, mean in [(1, 0.1), (2, 1e-9), (5, 0.3), (20, 3.0), (300, 100.0), (7, 9.0)]:
        got = spark.range(1).select(errors.log_surplus_chance(F.lit(n), F.lit(math.log(mean)))).first()[0]
        assert abs(got - log_tail(n, mean)) < 1e-3, (n, mean)


def test_surplus_chance_near_and_far_from_the_mean(spark):
    def chance(n, log_mean):
        return spark.range(1).select(errors.log_surplus_chance(F.lit(n), F.lit(log_mean))).first()[0]

    # Half of a Poisson lies above a large mean: hundreds of terms of the series count.
    n, mean = 100_001, 100_000.0
    terms = [math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(n, n + 4000)]
    assert abs(chance(n, math.log(mean)) - math.log(math.fsum(terms))) < 1e-6
    # A mean below the smallest double: P(X >= 5 | X >= 1) is mean^4 / 5!.
    assert abs(chance(5, -800.0) - (-3200 - math.log(120))) < 1e-3


def test_merge(spark, rows):
    pairs = spark.createDataFrame([
        ("s", "AAAACCCCGGGGTTTT", "GGATAAAACCCCGGGG", 3),   # rc CCCCGGGGTTTTATCC: overlap 12
        ("s", "AAAACCCCGGGGTTTT", "CCCCCCCCCCCCCCCC", 2)], "sample_id string, fwd string, rev string, n long")
    assert rows(dn.merge_pairs(pairs)) == [("s", "AAAACCCCGGGGTTTTATCC", 3)]
    assert rows(dn.merge_pairs(pairs, min_overlap=13)) == []
    one_off = spark.createDataFrame([("s", "AAAACCCCGGGGTTTA", "GGATAAAACCCCGGGG", 1)], pairs.schema)
    assert rows(dn.merge_pairs(one_off)) == []
    assert rows(dn.merge_pairs(one_off, max_mismatch=1)) == [("s", "AAAACCCCGGGGTTTAATCC", 1)]


def bimeras(spark, *asv):
    flags = dn.flag_bimeras(spark.createDataFrame(list(asv), "sample_id string, sequence string, n long"))
    return sorted((r.sample_id, r.sequence) for r in flags.filter("bimera").collect())


def test_bimera_of_two_parents(spark):
    parents = [("S1", "AAAACCCCGGGG", 100), ("S1", "TTTTGGGGCCCC", 90)]
    assert bimeras(spark, *parents, ("S1", "AAAACCGGCCCC", 5), ("S1", "ACGTACGTACGT", 4)) == [("S1", "AAAACCGGCCCC")]
    # in another sample there are no parents; less abundant sequences are none either
    assert bimeras(spark, *parents, ("S2", "AAAACCGGCCCC", 5)) == []
    assert bimeras(spark, *parents, ("S1", "AAAACCGGCCCC", 95)) == []


def test_indel_copy_of_one_parent_is_no_bimera(spark):
    assert bimeras(spark, ("S", "AAAACCCCGGGG", 100), ("S", "AAAACCCGGGG", 5)) == []


def test_bimeras_equal_brute_force(spark):
    rng = random.Random(4)
    asv = {}
    for sample in "ab":
        parents = ["".join(rng.choice("AC") for _ in range(rng.choice([10, 11]))) for _ in range(12)]
        for p in parents:
            asv[sample, p] = rng.randint(1, 30)
        for _ in range(20):
            x, y = rng.sample(parents, 2)
            asv.setdefault((sample, x[:rng.randint(0, 10)] + y[rng.randint(0, 10):]), rng.randint(1, 30))
    asv = {k: n for k, n in asv.items() if k[1]}

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    expected = []
    for (s, c), n in asv.items():
        rel = [(p, common(c, p), common(c[::-1], p[::-1])) for (s2, p), m in asv.items() if s2 == s and m > n and p != c]
        if any(a[1] + b[2] >= len(c) for a in rel for b in rel if a[0] != b[0]):
            expected.append((s, c))
    assert bimeras(spark, *[(s, c, n) for (s, c), n in asv.items()]) == sorted(expected)
    assert 0 < len(expected) < len(asv)


def test_consensus(spark):
    flags = [("x", True)] * 3 + [("y", True)] * 2 + [("y", False)] * 2 + [("z", True)] * 9 + [("z", False)] + [("w", False)]
    df = spark.createDataFrame(flags, "sequence string, bimera boolean")
    assert sorted(r.sequence for r in dn.consensus_bimeras(df).collect()) == ["x", "z"]


def test_whole_analysis_recovers_planted_sequences(spark):
    rng = random.Random(9)
    templates = ["".join(rng.choice("ACGT") for _ in range(90)) for _ in range(3)]
    flip = str.maketrans("ACGT", "TGCA")
    pairs = []
    for i in range(240):
        t = templates[i % 3]
        fwd, rev = t[:60], t[30:].translate(flip)[::-1]
        if i % 40 == 7:
            fwd = mutate(rng, fwd, 1)
        if i % 60 == 11:
            rev = mutate(rng, rev, 1)
        pairs.append(("a" if i % 4 else "b", i, fwd, "I" * 60, rev, "I" * 60))
    pairs.append(("b", 999, "ACGT", "IIII", "ACGT", "IIII"))
    df = spark.createDataFrame(pairs, "sample_id string, read_no long, fwd string, fwd_qual string, rev string, rev_qual string")
    out = reads_to_counts(df, trim_f=0, trim_r=0, trunc_f=60, trunc_r=60, max_iter=3, learn_from=None)
    assert sorted(r.sequence for r in out.sequences.collect()) == sorted(templates)
    stats = {r.sample_id: r for r in out.stats.collect()}
    assert (stats["a"].input, stats["b"].input, stats["b"].filtered) == (180, 61, 60)
    assert stats["a"].non_chimeric == 180 and stats["b"].non_chimeric == 60
    assert out.table.agg(F.sum("frequency")).first()[0] == 240
    for r in stats.values():
        assert r.input >= r.filtered >= r.denoised >= r.merged >= r.non_chimeric
