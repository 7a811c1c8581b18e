"""Durable results between steps (also used to cut lineage in iterative jobs)."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ampliframe.session import new_path, scratch_dir

# Bytes of a row group: a task holds one while it writes, and a file can be read in parts only between them.
ROW_GROUP = 16 << 20
# Paths stored since each open ``temporary_stages`` began.
_open_scopes: list[list[str]] = []


def _files(spark: SparkSession, path: str):
    """Spark's own file system for a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete_stage(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def persist_stage(df: DataFrame, name: str, path: str | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet and return the stored table.

    The table lies in the shared scratch folder unless ``path`` is given. Later steps read
    files, not lineage, so a lost executor costs a re-read only, and the optimiser plans
    with the true size. Inside ``temporary_stages`` it lasts until the end of that block, or with
    ``keep`` until the end of the one around it.
    """
    spark = df.sparkSession
    target = path or new_path(spark, name)
    df.write.mode("errorifexists").option("parquet.block.size", ROW_GROUP).parquet(target)
    scopes = _open_scopes[:-1] if keep else _open_scopes
    if scopes and path is None:
        scopes[-1].append(target)
    return spark.read.schema(df.schema).parquet(target)


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, unless stored with ``keep``. What leaves the block must
    be stored itself: a plan over deleted tables cannot run."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            delete_stage(spark, path)


class Rounds:
    """The state of a loop: each round's table is stored, then the one before is deleted. The last one
    belongs to the ``temporary_stages`` that were open when the loop began."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None
        self.scope = _open_scopes[-1] if _open_scopes else []

    def store(self, df: DataFrame) -> DataFrame:
        path, before = new_path(self.spark, self.name), self.path
        stored = persist_stage(df, self.name, path)
        self.scope.append(path)
        if before is not None:
            self.scope.remove(before)
            delete_stage(self.spark, before)
        self.path = path
        return stored


# ------------------------------------------------------------------------- named stages

_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")


def _folder(spark: SparkSession, name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not a stage name: {name!r}")
    return f"{scratch_dir(spark)}/stages/{name}"


def _published(spark: SparkSession, name: str) -> list[tuple[int, str, str]]:
    """Number, fingerprint and path of the stage's versions, oldest first."""
    files, where = _files(spark, _folder(spark, name))
    if not files.exists(where):
        return []
    found = [re.match(r"^(\d{8})-([0-9a-f]{32})$", s.getPath().getName()) for s in files.listStatus(where)]
    return sorted((int(m[1]), m[2], f"{_folder(spark, name)}/{m[0]}") for m in found if m)


def fingerprint(*inputs: object) -> str:
    """A text that changes when the inputs do: names, parameters, or tables (their files and columns)."""
    parts = [(sorted(x.inputFiles()), x.schema.json()) if isinstance(x, DataFrame) else x for x in inputs]
    return hashlib.md5(repr(parts).encode()).hexdigest()


def publish_stage(df: DataFrame, name: str, mark: str | None = None) -> DataFrame:
    """Store ``df`` under ``name`` for any later session with the same shared folder.

    The table is written aside and appears under its name in one step, a rename; a reader finds the old
    version or the new one, never a part. The version before is deleted then. ``mark`` (see
    ``fingerprint``) says what the table was made from.
    """
    spark = df.sparkSession
    old = _published(spark, name)
    aside = f"{_folder(spark, name)}/_{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(aside)
    target = f"{_folder(spark, name)}/{old[-1][0] + 1 if old else 0:08d}-{mark or uuid.uuid4().hex}"
    files, source = _files(spark, aside)
    if not files.rename(source, _files(spark, target)[1]):
        raise RuntimeError(f"could not publish stage {name!r}")
    for _, _, path in old:
        delete_stage(spark, path)
    return spark.read.schema(df.schema).parquet(target)


def stage(spark: SparkSession, name: str, mark: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The published stage if it was made from the same inputs, else ``build()``, published."""
    old = _published(spark, name)
    if old and old[-1][1] == mark:
        return spark.read.parquet(old[-1][2])
    return publish_stage(build(), name, mark)


def load_stage(spark: SparkSession, name: str) -> DataFrame:
    """The newest version of a named stage, or the table at a path."""
    if "/" in name:
        return spark.read.parquet(name)
    found = _published(spark, name)
    if not found:
        raise FileNotFoundError(f"no stage {name!r} in {scratch_dir(spark)}")
    return spark.read.parquet(found[-1][2])
