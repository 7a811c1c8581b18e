"""Stored stages: named ones, and those of loops."""

import os
import random
import subprocess
import sys

import pytest

from ampliframe.operators import denoise as dn
from ampliframe.session import scratch_dir
from ampliframe.sources.stage import Rounds, fingerprint, load_stage, persist_stage, publish_stage, stage, temporary_stages

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def tables(spark):
    return sorted(os.listdir(scratch_dir(spark)))


def test_a_new_session_reads_a_stage_by_name(spark, tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from ampliframe.sources.stage import load_stage, publish_stage
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
if sys.argv[1] == "write":
    publish_stage(spark.range(7), "table")
    publish_stage(spark.range(9), "table")
else:
    print("rows", load_stage(spark, "table").count())
"""
    for step in ("write", "read"):
        out = subprocess.run([sys.executable, "-c", code, step], capture_output=True, text=True, timeout=300)
        assert out.returncode == 0, out.stderr[-2000:]
    assert "rows 9" in out.stdout
    assert len(os.listdir(tmp_path / "stages" / "table")) == 1


def test_a_stage_is_built_again_only_when_its_inputs_change(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    source = persist_stage(spark.range(3), "source")
    mark = fingerprint(source, {"level": 2})
    assert stage(spark, "counts", mark, build).count() == stage(spark, "counts", mark, build).count() == 1
    assert stage(spark, "counts", fingerprint(source, {"level": 3}), build).count() == 2
    assert load_stage(spark, "counts").count() == 2 and len(built) == 2
    with pytest.raises(FileNotFoundError):
        load_stage(spark, "never-made")
    with pytest.raises(ValueError):
        publish_stage(spark.range(1), "../elsewhere")


def test_rounds_and_temporary_stages_leave_nothing(spark):
    before = tables(spark)
    with temporary_stages(spark):
        rounds = Rounds(spark, "state")
        for i in range(4):
            with temporary_stages(spark):
                state = rounds.store(persist_stage(spark.range(i), "inside"))
            assert len(tables(spark)) == len(before) + 1
        assert state.count() == 3
        kept = persist_stage(state, "result", keep=True)
    assert tables(spark) == before + [t for t in tables(spark) if t.startswith("result-")] or len(tables(spark)) == len(before) + 1
    assert kept.count() == 3


def test_scratch_does_not_grow_with_rounds(spark):
    rng = random.Random(0)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    uniques = spark.createDataFrame([("s", "F", base, 200, "?" * 60), ("s", "F", base[:30] + "T" + base[31:], 3, "?" * 60)],
                                    "sample_id string, direction string, sequence string, n long, quality string")
    before = len(tables(spark))
    rates = dn.learn_error_model(uniques)
    assert len(tables(spark)) == before + 1
    assert {(r.state, r.rounds) for r in rates.select("state", "rounds").distinct().collect()} == {("settled", 1)} or rates.first().state == "settled"
    with pytest.warns(RuntimeWarning):
        assert dn.learn_error_model(uniques, max_iter=1).first().state == "stopped"


def test_stored_tables_are_cut_into_row_groups(spark, monkeypatch):
    """A task holds one row group while it writes, and a file is read in parts only between them."""
    import pyarrow.parquet as pq

    from ampliframe.sources import stage as stages
    monkeypatch.setattr(stages, "ROW_GROUP", 1 << 16)
    table = persist_stage(spark.range(0, 200_000, 1, 1).selectExpr("id", "xxhash64(id) AS h"), "groups")
    assert table.count() == 200_000
    assert sum(pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).num_row_groups for f in table.inputFiles()) > 4
