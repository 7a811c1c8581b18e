import gzip
import json
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from ampliframe.operators import lookup, reads as rd
from ampliframe.plans.workflow import export_with_taxonomy
from ampliframe.session import new_path
from ampliframe.sources import sinks, text
from ampliframe.sources import fastq as fq
from ampliframe.sources.fastq import read_fastq_casava, read_fastq_pairs
from ampliframe.sources.stage import load_stage, persist_stage


def fastq(folder, name, records):
    with gzip.open(folder / name, "wt") as out:
        for read_id, seq, qual in records:
            out.write(f"@{read_id} 1:N:0:1\n{seq}\n+\n{qual}\n")


def joined(path):
    """The parts of a text export, joined in name order."""
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    return "".join(open(os.path.join(path, p)).read() for p in parts)


def test_fastq_folder(spark, tmp_path, rows):
    fastq(tmp_path, "a_b_12_L001_R1_001.fastq.gz", [("r1", "ACGT", "IIII"), ("r2", "AC", "@I"), ("r3", "AXG", "II"), ("r4", "A", "I")])
    fastq(tmp_path, "a_b_12_L001_R2_001.fastq.gz", [("r1", "TTTT", "IIII"), ("rX", "GG", "II"), ("r3", "CCC", "III")])
    fastq(tmp_path, "c_13_L002_R1_001.fastq.gz", [("q1", "ACGT", "IIII")])
    reads = read_fastq_casava(spark, str(tmp_path))
    assert reads.count() == 8
    second = reads.filter("read_id = 'r2'").first()
    assert (second.sample_id, second.lane, second.direction, second.read_no, second.seq, second.qual) == ("a_b", 1, "F", 1, "AC", "@I")
    assert {r.pair_error for r in rd.pair_mates(reads).collect()} == {None, "missing_reverse", "id_mismatch"}
    assert rows(rd.pair_mates(reads).filter("pair_error is not null").select("sample_id", "read_no", "pair_error")) == [
        ("a_b", 1, "id_mismatch"), ("a_b", 3, "missing_reverse"), ("c", 0, "missing_reverse")]
    assert rows(rd.validate_reads(reads).select("sample_id", "read_no", "error")) == [
        ("a_b", 2, "bad_base"), ("a_b", 2, "length_mismatch")]
    assert read_fastq_casava(spark, str(tmp_path), "R").count() == 3
    pairs = read_fastq_pairs(spark, str(tmp_path))
    assert rows(pairs) == rows(rd.pair_mates(reads)) and pairs.columns == rd.pair_mates(reads).columns
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("BatchScan") == 1


def test_each_file_is_opened_once_and_cut_in_blocks(tmp_path, monkeypatch):
    records = [(f"r{i}", "ACGT" * (i % 7), "IIII" * (i % 7)) for i in range(500)]
    fastq(tmp_path, "a_x_L001_R1_001.fastq.gz", records)
    fastq(tmp_path, "a_x_L001_R2_001.fastq.gz", [(i, s[::-1] + "N" * 9, q + "I" * 9) for i, s, q in records[:-20]])
    monkeypatch.setattr(fq, "BLOCK_BYTES", 777)
    opened, real = [], fq._records
    monkeypatch.setattr(fq, "_records", lambda files, file: opened.append(file.name) or real(files, file))
    reader = fq.PairsReader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    got = [r for batch in reader.read(part) for r in batch.to_pylist()]
    assert sorted(opened) == ["a_x_L001_R1_001.fastq.gz", "a_x_L001_R2_001.fastq.gz"]
    assert [(r["read_no"], r["read_id"], r["fwd"], r["fwd_qual"]) for r in got] == [(n, *r) for n, r in enumerate(records)]
    assert [r["rev"] for r in got] == [s[::-1] + "N" * 9 for _, s, _ in records[:-20]] + [None] * 20
    assert [r["pair_error"] for r in got] == [None] * 480 + ["missing_reverse"] * 20


def test_two_files_for_one_lane(spark, tmp_path):
    for barcode in ("x", "y"):
        fastq(tmp_path, f"a_{barcode}_L001_R1_001.fastq.gz", [("r1", "ACGT", "IIII")])
    found = rd.validate_reads(read_fastq_casava(spark, str(tmp_path))).collect()
    assert [(r.sample_id, r.direction, r.error) for r in found] == [("a", "F", "duplicate_file")]
    with pytest.raises(Exception, match="two files for one lane"):
        read_fastq_pairs(spark, str(tmp_path)).collect()


def test_other_files_are_named_and_unsound_pairs_stop(spark, tmp_path):
    fastq(tmp_path, "a_x_L001_R1_001.fastq.gz", [("r1", "ACGT", "IIII")])
    fastq(tmp_path, "a_x_L001_R2_001.fastq.gz", [("r1", "ACG", "IIII")])
    (tmp_path / "more").mkdir()
    with pytest.warns(RuntimeWarning, match="not read: more"):
        fq._list_files(str(tmp_path))
    with pytest.raises(Exception, match="unsound pair a 0 rev: length_mismatch"):
        rd.require_sound(read_fastq_pairs(spark, str(tmp_path))).collect()
    sound = read_fastq_pairs(spark, str(tmp_path)).withColumn("rev_qual", F.lit("III"))
    assert rd.require_sound(sound).collect() == sound.collect()
    with pytest.raises(Exception, match="id_mismatch"):
        rd.require_sound(sound.withColumn("pair_error", F.lit("id_mismatch"))).collect()
    (tmp_path / "b.fq.gz").write_bytes(b"")
    with pytest.raises(ValueError, match="unexpected fastq"):
        fq._list_files(str(tmp_path))


def test_broken_fastq_and_bad_names(spark, tmp_path):
    with gzip.open(tmp_path / "a_x_L001_R1_001.fastq.gz", "wt") as out:
        out.write("@r1\nACGT\n+\n")
    with pytest.raises(Exception):
        read_fastq_casava(spark, str(tmp_path)).collect()
    (tmp_path / "odd.fastq.gz").write_bytes(b"")
    with pytest.raises(Exception, match="unexpected fastq"):
        read_fastq_casava(spark, str(tmp_path)).collect()


def test_mapping_file(spark, tmp_path):
    path = tmp_path / "map.txt"
    path.write_text("#SampleID\tsite.name\tdepth\tnote\ns1\tA\t1.5\t\ns2\tB\t\t7\ns3\t9x\t3\t\n")
    meta = text.read_sample_metadata(spark, str(path))
    assert meta.dtypes == [("sample_id", "string"), ("site.name", "string"), ("depth", "double"), ("note", "double")]
    assert sorted(map(tuple, meta.collect())) == [("s1", "A", 1.5, None), ("s2", "B", None, 7.0), ("s3", "9x", 3.0, None)]
    path2 = tmp_path / "twice.txt"
    path2.write_text("id\tx\ns1\t1\ns1\t2\n")
    with pytest.raises(ValueError, match="repeated"):
        text.read_sample_metadata(spark, str(path2))


def test_taxonomy_text(spark, tmp_path, rows):
    tsv, comma = tmp_path / "t.tsv", tmp_path / "t.csv"
    tsv.write_text("Feature ID\tTaxon\tConfidence\nf1\tD_0__A;D_1__B\t0.9\n")
    comma.write_text('Feature.ID,Taxon,Confidence\nf1,"D_0__A, sp.",0.9\n')
    assert rows(text.read_taxonomy(spark, str(tsv), confidence_col="Confidence")) == [("f1", "D_0__A;D_1__B", 0.9)]
    assert rows(text.read_taxonomy(spark, str(comma), ",", "Feature.ID")) == [("f1", "D_0__A, sp.")]


WIDE = "# Constructed from biom file\n#OTU ID\ts1\ts2\nf1\t12.0\t0.0\nf2\t0.0\t0.0\nf3\t1.0\t3.0\n"


def test_wide_table_text(spark, tmp_path, rows):
    path = tmp_path / "wide.txt"
    path.write_text(WIDE)
    wide = text.read_biom_tsv(spark, str(path))
    assert wide.columns == ["#OTU ID", "s1", "s2"]
    assert rows(wide) == [("f1", 12.0, 0.0), ("f2", 0.0, 0.0), ("f3", 1.0, 3.0)]
    assert rows(text.read_biom_long(spark, str(path))) == [("f1", "s1", 12.0), ("f3", "s1", 1.0), ("f3", "s2", 3.0)]
    path.write_text(WIDE.replace("12.0", "many"))
    with pytest.raises(Exception):
        text.read_biom_long(spark, str(path)).collect()
    with pytest.raises(Exception):
        text.read_biom_tsv(spark, str(path)).collect()


@pytest.fixture
def ft(spark):
    return spark.createDataFrame([("f1", "s1", 12), ("f3", "s1", 1), ("f3", "s3", 3), ("f2", "s2", 5)],
                                 "feature_id string, sample_id string, frequency long")


@pytest.fixture
def tax(spark):
    return spark.createDataFrame([("f1", 'D_0__A;D_1__"B"', 0.9), ("f3", "D_0__C", 1.0), ("f9", "D_0__Z", 0.8)],
                                 "feature_id string, taxon string, confidence double")


def test_wide_export(spark, ft, tax):
    path = new_path(spark, "wide")
    sinks.write_biom_tsv(ft, path, tax)
    assert joined(path) == ("# Constructed from biom file\n#OTU ID\ts1\ts2\ts3\ttaxonomy\n"
                            'f1\t12.0\t0.0\t0.0\tD_0__A;D_1__"B"\nf2\t0.0\t5.0\t0.0\tNA\nf3\t1.0\t0.0\t3.0\tD_0__C\n')
    long = text.read_biom_long(spark, path)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, ft.collect()))
    path = new_path(spark, "wide")
    sinks.write_biom_tsv(ft.limit(0), path)
    assert joined(path) == "# Constructed from biom file\n#OTU ID\n"


def test_table_text(spark):
    df = spark.createDataFrame([("b", 2.0, None), ("a", 1.25, 'x"y')], "id string, v double, t string")
    path = new_path(spark, "quoted")
    sinks.write_table(df, path, ["id"])
    assert joined(path) == '"id"\t"v"\t"t"\n"a"\t1.25\t"x\\"y"\n"b"\t2\tNA\n'
    path = new_path(spark, "plain")
    sinks.write_table(df, path, ["id"], quote=False, comment="# c")
    assert joined(path) == '# c\nid\tv\tt\na\t1.25\tx"y\nb\t2\tNA\n'


def test_export_with_taxonomy(spark, tmp_path, tax):
    source = tmp_path / "wide.txt"
    source.write_text(WIDE)
    path = new_path(spark, "export")
    export_with_taxonomy(text.read_biom_tsv(spark, str(source)), tax, path)
    assert joined(path) == ("# Constructed from biom file\n#OTU ID\ts1\ts2\ttaxonomy\n"
                            'f1\t12\t0\tD_0__A;D_1__"B"\nf2\t0\t0\tNA\nf3\t1\t3\tD_0__C\n')


def test_json_export(spark, ft, tax):
    path = new_path(spark, "json")
    sinks.write_biom_json(ft, tax, path, date="2020-05-14T00:00:00")
    doc = json.loads(joined(path))
    assert doc["shape"] == [3, 3] and doc["type"] == "OTU table" and doc["matrix_type"] == "sparse"
    assert (doc["date"], doc["generated_by"], doc["id"]) == ("2020-05-14T00:00:00", "ampliframe", None)
    assert doc["format_url"].startswith("http") and doc["matrix_element_type"] == "int"
    assert [r["id"] for r in doc["rows"]] == ["f1", "f2", "f3"]
    assert doc["rows"][0]["metadata"] == {"taxonomy": ["D_0__A", 'D_1__"B"']}
    assert [c["id"] for c in doc["columns"]] == ["s1", "s2", "s3"]
    assert doc["data"] == [[0, 0, 12], [1, 1, 5], [2, 0, 1], [2, 2, 3]]
    path = new_path(spark, "json")
    sinks.write_biom_json(ft.limit(0), None, path)
    assert json.loads(joined(path))["data"] == []


def test_taxonomy_export_and_stage(spark, tax, rows):
    path = new_path(spark, "tax")
    sinks.export_taxonomy(tax, path)
    assert joined(path).startswith("Feature ID\tTaxon\tConfidence\nf1\t")
    stored = persist_stage(tax, "tax")
    assert rows(stored) == rows(tax) and stored.schema == tax.schema
    path = new_path(spark, "named")
    persist_stage(tax, "tax", path)
    assert rows(load_stage(spark, path)) == rows(tax)
    with pytest.raises(Exception):
        persist_stage(tax, "tax", path)


def block_gzip(path, data, block=1000):
    """Members that state their size, as block-gzip tools write them, with the empty one at the end."""
    with open(path, "wb") as out:
        for at in [*range(0, len(data), block), None]:
            part = b"" if at is None else data[at:at + block]
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = packer.compress(part) + packer.flush()
            size = 18 + len(body) + 8
            out.write(b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, size - 1)
                      + body + struct.pack("<II", zlib.crc32(part), len(part)))


def reads_text(n, seed=0):
    """Records with qualities that look like headers or separators, and empty ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 40, 151])
        seq, qual = "".join(rng.choice("ACGTN") for _ in range(size)), "".join(rng.choice("@+I#") for _ in range(size))
        out.append((f"r{i}", seq, qual))
    return out, "".join(f"@{r} 1:N:0:1\n{s}\n+{r if rng.random() < .3 else ''}\n{q}\n" for r, s, q in out).encode()


@pytest.mark.parametrize("block,split", [(1000, 900), (333, 2000), (5000, 150), (61, 100)])
def test_block_gzip_in_parts_equals_one_task(spark, tmp_path, rows, monkeypatch, block, split):
    records, data = reads_text(400)
    block_gzip(tmp_path / "a_x_L001_R1_001.fastq.gz", data, block)
    fastq(tmp_path, "b_x_L001_R1_001.fastq.gz", records)  # plain gzip: one task
    reader = fq.FastqReader({"path": str(tmp_path), "split_bytes": str(split)})
    parts = reader.partitions()
    assert sum(p.end is not None for p in parts) > 3 and sum(p.end is None for p in parts) == 1
    monkeypatch.setattr(fq, "BLOCK_BYTES", 700)
    found = [r for p in parts if p.end is not None for batch in reader.read(p) for r in batch.to_pylist()]
    assert [(r["read_id"], r["seq"], r["qual"]) for r in found] == records


def test_block_gzip_source(spark, tmp_path, rows):
    records, data = reads_text(3000)
    block_gzip(tmp_path / "a_x_L001_R1_001.fastq.gz", data, 4000)
    block_gzip(tmp_path / "a_x_L001_R2_001.fastq.gz", data, 5000)
    fastq(tmp_path, "b_x_L002_R1_001.fastq.gz", records[:50])
    one, cut = read_fastq_casava(spark, str(tmp_path)), read_fastq_casava(spark, str(tmp_path), split_bytes=9000)
    assert cut.rdd.getNumPartitions() > one.rdd.getNumPartitions() == 3
    assert rows(cut) == rows(one) and cut.columns == one.columns
    assert rows(read_fastq_pairs(spark, str(tmp_path), split_bytes=9000)) == rows(read_fastq_pairs(spark, str(tmp_path)))
    with pytest.raises(Exception, match="ends inside"):
        block_gzip(tmp_path / "c_x_L001_R1_001.fastq.gz", data + b"@cut\nACGT\n", 4000)
        read_fastq_casava(spark, str(tmp_path), split_bytes=9000).collect()


def test_filters_choose_files(spark, tmp_path):
    for sample in "ab":
        for mate in (1, 2):
            fastq(tmp_path, f"{sample}_x_L00{mate}_R{mate}_001.fastq.gz", [(f"{sample}{mate}", "ACGT", "IIII")])
    chosen = read_fastq_casava(spark, str(tmp_path), "R", samples=["a"], lanes=[1, 2])
    assert [r.read_id for r in chosen.collect()] == ["a2"] and chosen.rdd.getNumPartitions() == 1
    assert read_fastq_casava(spark, str(tmp_path), lanes=[2]).count() == 2
    reads = read_fastq_casava(spark, str(tmp_path))
    assert {d: reads.filter(F.col("direction") == d).unionAll(reads.filter("direction = 'R'")).count() for d in "FR"} == {"F": 4, "R": 4}
    some = read_fastq_casava(spark, str(tmp_path), push_filters=True).filter("sample_id = 'a' and direction in ('R') and read_no >= 0")
    assert [r.read_id for r in some.collect()] == ["a2"] and some.rdd.getNumPartitions() == 1
    left = [line for line in some._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter (" in line]
    assert len(left) == 1 and ">= 0" in left[0] and "= a" not in left[0] and "= R" not in left[0]


def test_ragged_text_stops_the_job(spark, tmp_path):
    path = tmp_path / "wide.tsv"
    for line in ("f2\t1.0", "f3\t1.0\t2.0\t3.0", "# Constructed from biom file"):
        path.write_text(f"# Constructed from biom file\n#OTU ID\ta\tb\nf1\t1.0\t2.0\n{line}\n")
        with pytest.raises(Exception, match="cells"):
            text.read_biom_tsv(spark, str(path)).collect()
        with pytest.raises(Exception, match="cells"):
            text.read_biom_tsv(spark, str(path)).filter("a > 0").collect()
        with pytest.raises(Exception, match="cells"):
            text.read_biom_long(spark, str(path)).collect()


def test_a_line_like_the_header_stays(spark, tmp_path, rows):
    path = tmp_path / "map.tsv"
    path.write_text("id\tsite\ns1\tx\nid\tsite\ns2\ty\n")
    assert rows(text.read_sample_metadata(spark, str(path))) == [("id", "site"), ("s1", "x"), ("s2", "y")]
    path.write_text('Feature ID\tTaxon\nf1\t"D_0__A; D_1__""B"""\n\nf1\t"D_0__A; D_1__""B"""\n')
    assert rows(text.read_taxonomy(spark, str(path))) == [("f1", 'D_0__A; D_1__"B"')]


def test_repeated_ids_never_multiply_rows(spark, tmp_path, rows):
    path = tmp_path / "tax.tsv"
    path.write_text("Feature ID\tTaxon\nf1\tD_0__A\nf1\tD_0__B\n")
    with pytest.raises(Exception, match="different rows for f1"):
        text.read_taxonomy(spark, str(path)).collect()
    counts = spark.createDataFrame([("f1", "a", 5)], "feature_id string, sample_id string, frequency long")
    twice = spark.createDataFrame([("f1", "D_0__A"), ("f1", "D_0__A")], "feature_id string, taxon string")
    sinks.write_biom_tsv(counts, str(tmp_path / "out"), twice)
    assert joined(tmp_path / "out") == "# Constructed from biom file\n#OTU ID\ta\ttaxonomy\nf1\t5.0\tD_0__A\n"
    with pytest.raises(Exception, match="different rows for f1"):
        sinks.write_biom_tsv(counts, str(tmp_path / "bad"), twice.unionAll(spark.createDataFrame([("f1", "D_0__Z")], twice.schema)))
    per_sample = spark.createDataFrame([("a", 1)], "sample_id string, n long")
    meta = spark.createDataFrame([("a", "x"), ("a", "y")], "sample_id string, site string")
    assert rows(lookup.attach_metadata(per_sample, meta.limit(1).unionAll(meta.limit(1)))) == [("a", 1, "x")]
    with pytest.raises(Exception, match="different rows for a"):
        lookup.attach_metadata(per_sample, meta).collect()


def test_zeros_of_a_wide_table_take_no_room(spark, tmp_path):
    """300 samples and features with a count each: some 90,000 cells of text, hardly any of it on disk."""
    ft = spark.range(300).selectExpr("concat('f', id) AS feature_id", "concat('s', id) AS sample_id", "id + 1 AS frequency")
    sinks.write_biom_tsv(ft, str(tmp_path / "wide"), compression="gzip")
    assert sum(p.stat().st_size for p in (tmp_path / "wide").glob("part-*")) < 300 * 300
    assert {(r.feature_id, r.frequency) for r in text.read_biom_long(spark, str(tmp_path / "wide")).collect()} == {(f"f{i}", i + 1.0) for i in range(300)}
