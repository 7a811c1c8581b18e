"""Helpers shared by the training-data operators.

Rules that hold for all of them unless an operator says otherwise:

* a null text is an empty one; texts are always read whole;
* input rows are told apart by ``(doc_id, hash of the text)``, so fully repeated rows and rows
  that share an id are both allowed; a null ``doc_id`` is a value of its own;
* extra input columns are ignored, or carried along boxed in one struct, so their names cannot
  clash with columns that the operator makes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ampliframe.session import configure

#: White space of the word and line rules: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A run of characters outside SPACES.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which stay while the driver holds their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; when its task ends, the worker, which stays for later tasks, returns the memory
    it no longer uses to the system. Allocators keep it otherwise, beside whatever the JVM takes next."""
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return lean


def boxed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row`` (all input columns in one struct), ``doc_id``, ``text`` (never null) and ``_t``,
    a hash that tells apart texts under one id."""
    return (docs.select(F.struct("*").alias("_row"))
            .select("_row", F.col("_row").getField(key).alias("doc_id"),
                    F.coalesce(F.col("_row").getField(text), F.lit("")).alias("text"))
            .withColumn("_t", F.xxhash64("text")))


def plain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``doc_id``, ``text`` (never null) and ``_t``."""
    return boxed(docs, key, text).drop("_row")


def unboxed(frame: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The input columns out of ``_row``, some of them replaced."""
    return frame.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in columns])


def join_rows(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on ``doc_id`` (null equals null) and ``_t``; ``other`` has one row per such pair."""
    other = other.withColumnsRenamed({"doc_id": "_other_id", "_t": "_other_t"})
    same = F.col("doc_id").eqNullSafe(F.col("_other_id")) & (F.col("_t") == F.col("_other_t"))
    return rows.join(other, same, how).drop("_other_id", "_other_t")


#: A bitmap of 2^23 bits (1 MB) as ``SLICES`` rows of ``WORDS`` numbers.
SLICES, WORDS = 256, 512


def _bit_of() -> tuple[Column, Column, Column]:
    h = F.xxhash64("doc_id", "_t")
    return (F.pmod(h, F.lit(SLICES)).cast("int"), F.pmod(F.shiftright(h, 8), F.lit(WORDS)).cast("int"),
            F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int"))


def split_by(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may be among ``keys`` (``doc_id, _t``), and those that certainly are not.

    Keys set bits of a bitmap of fixed size, which alone goes to all executors. Few rows share a
    bit with a key by chance, so a join of the first part moves few texts that it does not need;
    with so many keys that the bitmap is full, it moves all, as a plain join would.
    """
    piece, word, bit = _bit_of()
    words = (keys.select(piece.alias("_slice"), word.alias("_word"), bit.alias("_bit"))
             .groupBy("_slice", "_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
             .groupBy("_slice").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map"))
             .select(F.col("_slice").alias("_piece"), F.transform(
                 F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0).cast("long"))).alias("_words")))
    columns = rows.columns
    marked = rows.withColumn("_slice", piece).join(F.broadcast(words), F.col("_slice") == F.col("_piece"), "left")
    maybe = F.coalesce(F.getbit(F.get("_words", word), bit) == 1, F.lit(False))
    return marked.filter(maybe).select(*columns), marked.filter(~maybe).select(*columns)


def without_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that are not among ``keys``."""
    maybe, others = split_by(rows, keys)
    return others.unionAll(join_rows(maybe, keys, "left_anti"))


def wide_hash(*columns: Column | str) -> list[Column]:
    """Two 64-bit hashes ``h1``, ``h2`` under different seeds: a 128-bit key, so that chance
    collisions stay out of reach at any corpus size."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(7919), *columns).alias("h2")]


def map_rows(df: DataFrame, work: Callable[[list[dict]], pa.Table | dict], schema: str) -> DataFrame:
    """Arrow map over slices of ``SLICE`` rows: ``work`` gets the columns as lists in a dict and
    returns a dict of output columns. Memory is bounded by a slice, whatever a batch holds."""
    names, kinds = zip(*_arrow_fields(df.sparkSession, schema))
    target = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=target)

    return df.mapInArrow(run, schema)


def _arrow_fields(spark: SparkSession, schema: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType
    return [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]
