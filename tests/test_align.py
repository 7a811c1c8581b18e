import random
from collections import Counter

from ampliframe.operators import align


def table(spark, seqs):
    return spark.createDataFrame(list(seqs.items()), "feature_id string, sequence string")


def test_known_alignment(spark):
    seqs = {"a": "ACGTACGT", "b": "ACGTTTACGT", "c": "ACGACGT"}
    got = {r.feature_id: r.aligned for r in align.star_align(table(spark, seqs), "ACGTACGT").collect()}
    assert len({len(v) for v in got.values()}) == 1 and len(got["a"]) == 10
    assert {k: v.replace("-", "") for k, v in got.items()} == seqs
    assert got["c"].count("-") == 3 and got["a"].count("-") == 2


def score(a, b):
    row = [align.GAP * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [align.GAP * i]
        for j, y in enumerate(b, 1):
            new.append(max(row[j - 1] + (align.MATCH if x == y else align.MISMATCH), row[j] + align.GAP, new[-1] + align.GAP))
        row = new
    return row[-1]


def test_pairwise_alignments_are_optimal(spark):
    rng = random.Random(1)
    centre = "".join(rng.choice("ACGT") for _ in range(30))
    seqs = {"empty": "", "same": centre}
    for i in range(40):
        s = list(centre)
        for _ in range(rng.randint(0, 6)):
            p = rng.randrange(len(s))
            s[p:p + rng.choice([0, 1, 1, 2])] = rng.choice(["", "A", "CG", "T"])
        seqs[str(i)] = "".join(s)
    for r in align.align_to(table(spark, seqs), centre).collect():
        inserts = {x.place: x.text for x in r.inserts}
        total = sum(align.GAP * len(t) for t in inserts.values())
        total += sum(align.GAP if b == "-" else align.MATCH if b == c else align.MISMATCH for b, c in zip(r.bases, centre))
        assert total == score(centre, seqs[r.feature_id])
        whole = "".join(inserts.get(i, "") + r.bases[i:i + 1] for i in range(len(centre) + 1))
        assert whole.replace("-", "") == seqs[r.feature_id]


def test_mask(spark):
    aln = spark.createDataFrame([("a", "A-CGA"), ("b", "A-CTC"), ("c", "AGC-G"), ("d", "A-CCT")],
                                "feature_id string, aligned string")
    got = {r.feature_id: r.aligned for r in align.mask_alignment(aln).collect()}
    assert got == {"a": "AC", "b": "AC", "c": "AC", "d": "AC"}
    strict = {r.feature_id: r.aligned for r in align.mask_alignment(aln, 1.0, 0.25).collect()}
    assert strict["c"] == "AGC-G"
    assert {r.aligned for r in align.mask_alignment(aln, 1.0, 1.1).collect()} == {""}


def test_distance_to_centre(spark):
    got = {r.feature_id: r.distance for r in align.kmer_distance(
        table(spark, {"same": "ACGTACGTAC", "far": "TTTTTTTTTT"}), "ACGTACGTAC").collect()}
    assert got == {"same": 0.0, "far": 1.0}


def test_centre_choice(spark):
    seqs = table(spark, {"a": "AC", "b": "ACG"})
    counts = spark.createDataFrame([("a", "s", 5), ("b", "s", 3)], "feature_id string, sample_id string, frequency long")
    assert align.choose_centre(seqs, counts) == "AC" and align.choose_centre(seqs) == "ACG"


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.choice([30, 40]))) for _ in range(15)]
    for s in list(seqs):
        for _ in range(3):
            p = rng.randrange(len(s))
            seqs.append(rng.choice([s[:p] + rng.choice("ACGT") + s[p + 1:], s[:p] + s[p + 2:], s + s[:p], s[p // 2:]]))
    seqs = sorted({s for s in seqs if len(s) > 5}) + ["ACACACACACACACACAC", "ACACACACAC", "ACG", "NNNNNNNNNN", "ACGTNACGTACGTAC"]
    words = {f"s{i:03d}": Counter(w for w in (s[j:j + 6] for j in range(len(s) - 5)) if "N" not in w) for i, s in enumerate(seqs)}
    frame = spark.createDataFrame([(f"s{i:03d}", s) for i, s in enumerate(seqs)], "feature_id string, sequence string")
    for limit in (0.3, 0.75, 1.0):
        expected = {}
        for a, x in words.items():
            for b, y in words.items():
                if x and (y.total(), b) > (x.total(), a):
                    share = (x & y).total() / x.total()
                    if share >= limit:
                        expected[a, b] = round(share, 9)
        got = align.kmer_neighbours(frame, limit).collect()
        assert {(r.a, r.b): round(r.similarity, 9) for r in got} == expected and len(got) == len(expected) > 0
