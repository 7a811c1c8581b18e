"""Token counts of flat token files: a separator scan over blocks, stitched by a prefix scan.

A flat file is nothing but ids, little-endian unsigned 16- or 32-bit, each document closed by an
end-of-document id. Nothing says where a document begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from ampliframe.llm.bpe import SharedCodec
from ampliframe.llm.common import _arrow_fields, plain
from ampliframe.session import new_path
from ampliframe.sources.stage import persist_stage

BLOCK_BYTES = 4 << 20


def write_flat(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, key: str = "doc_id",
               text: str = "text", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the documents as flat files, one per task, and return two stored tables: the files
    (``file, bytes``) and which document stands where (``file, doc_no, doc_id``).

    A task that is repeated writes a new file; files of lost attempts are in neither table, so
    they are never read. Null and empty texts are an ``end_id`` alone.
    """
    spark = docs.sparkSession
    shared, folder = SharedCodec(spark, vocabulary, pattern), path or new_path(spark, "token-files")
    schema = "file string, doc_no long, doc_id long, bytes long"
    fields = pa.schema(_arrow_fields(spark, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        codec, stream, no = shared.get(), None, 0
        width = "<u2" if max(end_id, len(codec.vocabulary.tokens) - 1) < 1 << 16 else "<u4"
        end = np.array([end_id], width).tobytes()
        for batch in batches:
            rows = {"file": [], "doc_no": [], "doc_id": [], "bytes": []}
            for doc, value in zip(batch.column(0), batch.column(1)):
                if stream is None:
                    fs, where = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(where, recursive=True)
                    stream = pafs.FileSystem.from_uri(name)[0].open_output_stream(pafs.FileSystem.from_uri(name)[1])
                data = np.frombuffer(codec.encode(value.as_py()), "<u4").astype(width).tobytes() + end
                stream.write(data)
                for column, x in zip(rows.values(), (name, no, doc.as_py(), len(data))):
                    column.append(x)
                no += 1
            yield pa.RecordBatch.from_pydict(rows, schema=fields)
        if stream is not None:
            stream.close()

    order = persist_stage(plain(docs, key, text).select("doc_id", "text").mapInArrow(run, schema), "token-file-order")
    files = persist_stage(order.groupBy("file").agg(F.sum("bytes").alias("bytes")), "token-file-list")
    return files, order.select("file", "doc_no", "doc_id")


def _blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    last = F.floor((F.col("bytes") - 1) / F.lit(block_bytes)).cast("long")
    spread = files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    # Blocks of one file go to many tasks.
    return spread.repartition("file", "block")


def scan_blocks(files: DataFrame, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, block, part, n``: part -1 is the block's summary (``n``: ids in it, ``ends``: separators
    in it, ``tail``: ids behind the last one); parts from 0 are the stretches that end in the
    block, the first of which may have begun in an earlier block."""
    schema = "file string, block long, part long, n long, ends long, tail long"
    fields = pa.schema(_arrow_fields(files.sparkSession, schema))
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size % width:
                    raise ValueError(f"{file}: {size} bytes are no whole number of ids")
                fs, where = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(where) as stream:
                    ids = np.frombuffer(stream.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes), f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                lengths = np.diff(np.concatenate([[-1], ends])) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                n = len(ends) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([file] * n, pa.string()), pa.array(np.full(n, block)), pa.array(np.arange(-1, n - 1)),
                    pa.array(np.concatenate([[len(ids)], lengths]).astype(np.int64)),
                    pa.array(np.full(n, len(ends))), pa.array(np.full(n, tail))], schema=fields)

    return _blocks(files, block_bytes).mapInArrow(run, schema)


def count_tokens(files: DataFrame, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, doc_no, n_tokens`` of every document in the flat files (``file, bytes``), without its
    end id; ids behind a file's last end id are a document without end.

    Blocks are scanned apart. A prefix scan over the block summaries, one row per block, then
    gives each block the number of documents that end before it and the ids carried into it.
    An empty file holds no document; equal end ids in a row enclose empty documents.
    """
    parts = persist_stage(scan_blocks(files, end_id, width, block_bytes), "token-blocks")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = parts.filter("part = -1").select("file", "block", "n", "ends", "tail")
    # Ids since the start of the file, and up to the last separator, before each block.
    marked = summary.withColumn("_all", F.sum("n").over(order)).withColumn(
        "_cut", F.when(F.col("ends") > 0, F.col("_all") - F.col("tail")))
    carried = marked.select(
        "file", "block", "ends", "tail",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first_no"),
        (F.col("_all") - F.col("n") - F.coalesce(F.max("_cut").over(before), F.lit(0))).alias("carry"))
    inside = (parts.filter("part >= 0").select("file", "block", "part", "n").join(carried, ["file", "block"])
              .select("file", (F.col("first_no") + F.col("part")).alias("doc_no"),
                      (F.col("n") + F.when(F.col("part") == 0, F.col("carry")).otherwise(0)).alias("n_tokens")))
    total = carried.groupBy("file").agg(F.max_by(F.struct(
        (F.col("first_no") + F.col("ends")).alias("doc_no"),
        (F.col("tail") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(0)).alias("n_tokens")), "block").alias("x"))
    return inside.unionAll(total.select("file", "x.doc_no", "x.n_tokens").filter("n_tokens > 0"))


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, key: str = "doc_id",
                 text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens``: the documents written as flat files, counted from the files, and joined
    to their ids by place."""
    spark = docs.sparkSession
    files, order = write_flat(docs, vocabulary, pattern, end_id, key, text)
    biggest = len(SharedCodec(spark, vocabulary, pattern).get().vocabulary.tokens) - 1
    counts = count_tokens(files, end_id, 2 if max(end_id, biggest) < 1 << 16 else 4, block_bytes)
    return order.join(counts, ["file", "doc_no"]).select("doc_id", "n_tokens")
