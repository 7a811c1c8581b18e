"""Reader for a folder of paired, gzipped fastq files, one file per sample and direction.

Plain gzip is one task per file. Block gzip (members of at most 64 KB that state their size in a
header field) is cut into parts of ``split_bytes``: a task starts at the first block behind its offset,
finds the first record behind the first line end, and reads on to the end of the last record that
begins in its blocks. Record numbers are places in the part plus the counts of the parts before.
"""

from __future__ import annotations

import json
import re
import struct
import warnings
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ampliframe.operators.reads import pair_mates
from ampliframe.schema import DIRECTED_READS, PAIRED_READS

# Fixed value: <sample>_<barcode>_L<lane>_R<1|2>_001.fastq.gz
FILE_NAME = re.compile(r"^(?P<sample>.+)_[^_]+_L(?P<lane>\d+)_R(?P<mate>[12])_001\.fastq\.gz$")
READS_NAME = re.compile(r"\.(fastq|fq)(\.gz)?$")
BLOCK_BYTES = 4 << 20
# Compressed bytes of one part of a block-gzip file.
SPLIT_BYTES = 64 << 20
# How a gzip member with extra fields begins, and the field that holds its size.
MEMBER, SIZE_FIELD = b"\x1f\x8b\x08\x04", b"BC"
# A member and its header are never larger.
MAX_MEMBER = 1 << 16

PAIRS = T.StructType([*PAIRED_READS, T.StructField("pair_error", T.StringType())])
PARTS = T.StructType([*DIRECTED_READS, T.StructField("part", T.IntegerType())])
COUNTS = T.StructType([*(f for f in DIRECTED_READS if f.name in ("sample_id", "lane", "direction", "file")),
                       T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType())])


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


class FastqFile(InputPartition):
    """A file, or the part of it whose blocks begin from ``start`` to before ``end``."""

    def __init__(self, path: str, sample_id: str, lane: int, direction: str, part: int = 0, start: int = 0, end: int | None = None):
        self.path, self.sample_id, self.lane, self.direction = path, sample_id, lane, direction
        self.part, self.start, self.end = part, start, end

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


class Mates(InputPartition):
    """The files of one sample and lane, by direction."""

    def __init__(self, sample_id: str, lane: int, files: dict[str, FastqFile]):
        self.sample_id, self.lane, self.files = sample_id, lane, files


def _list_files(folder: str) -> list[FastqFile]:
    """The read files of a folder. A reads file with another name is an error; anything else
    in the folder is left out with a warning."""
    files, root = _filesystem(folder)
    found, others = [], []
    for info in files.get_file_info(fs.FileSelector(root, recursive=False)):
        name = FILE_NAME.match(info.base_name)
        if name is not None and info.type == fs.FileType.File:
            direction = "F" if name["mate"] == "1" else "R"
            found.append(FastqFile(info.path, name["sample"], int(name["lane"]), direction))
        elif READS_NAME.search(info.base_name):
            raise ValueError(f"unexpected fastq file name: {info.base_name}")
        else:
            others.append(info.base_name)
    if not found:
        raise ValueError(f"no fastq files in {folder}")
    if others:
        warnings.warn(f"not read: {', '.join(sorted(others))}", RuntimeWarning, stacklevel=2)
    return found


def _records(files: fs.FileSystem, file: FastqFile) -> Iterator[pa.RecordBatch]:
    """``read_id, seq, qual`` of a file, one batch per decompressed block."""
    rest, before = b"", 0
    with files.open_input_stream(file.path, compression="gzip") as raw:
        while True:
            block = raw.read(BLOCK_BYTES)
            data = rest + block
            if not block and data and not data.endswith(b"\n"):
                data += b"\n"
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
            if not block and len(ends) % 4:
                raise ValueError(f"{file.name}: the file ends inside a record")
            ends = ends[:len(ends) // 4 * 4]
            if len(ends):
                yield _parse(data[:ends[-1]], ends, file.name, before)
                rest, before = data[ends[-1]:], before + len(ends) // 4
            else:
                rest = data
            if not block:
                return


def _parse(data: bytes, ends: np.ndarray, name: str, before: int) -> pa.RecordBatch:
    """Four lines make one record; all lines of a block are cut at once."""
    if not data.isascii():
        raise ValueError(f"{name}: not ASCII")
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    lines = pc.ascii_rtrim(
        pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data)), characters="\r\n")
    header, seq, plus, qual = (lines.take(pa.array(np.arange(i, len(ends), 4))) for i in range(4))
    sound = pc.and_(pc.starts_with(header, "@"), pc.starts_with(plus, "+"))
    if not pc.all(sound).as_py():
        raise ValueError(f"{name}: record {before + pc.index(sound, False).as_py()} is not fastq")
    read_id = pc.list_element(pc.split_pattern(pc.utf8_slice_codeunits(header, 1), " ", max_splits=1), 0)
    return pa.RecordBatch.from_arrays([read_id, seq, qual], ["read_id", "seq", "qual"])


# ------------------------------------------------------------------------- block gzip

def _member_size(data: bytes, at: int) -> int | None:
    """Size of the block that begins at ``at``, or None if none does or its header is cut off."""
    if data[at:at + 4] != MEMBER or len(data) < at + 12:
        return None
    end = at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    place = at + 12
    while place + 6 <= min(end, len(data)):
        length = struct.unpack_from("<H", data, place + 2)[0]
        if data[place:place + 2] == SIZE_FIELD and length == 2:
            return struct.unpack_from("<H", data, place + 4)[0] + 1
        place += 4 + length
    return None


def _first_member(source, start: int, size: int) -> int:
    """Where the first block at or behind ``start`` begins: its stated size must lead to another
    block or to the end of the file."""
    data = source.read_at(min(3 * MAX_MEMBER, size - start), start)
    at = data.find(MEMBER)
    while at >= 0:
        length = _member_size(data, at)
        if length and (start + at + length == size or _member_size(data, at + length)):
            return start + at
        at = data.find(MEMBER, at + 1)
    return size


def _inflated(source, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """The blocks from ``at`` on: where each begins, and its content."""
    data, base = b"", at
    while base < size:
        length = _member_size(data, 0)
        if length is None or length > len(data):
            more = source.read_at(min(BLOCK_BYTES, size - base - len(data)), base + len(data))
            if not more:
                raise ValueError(f"the file ends inside a block at {base}")
            data += more
            continue
        yield base, zlib.decompress(data[:length], wbits=31)
        data, base = data[length:], base + length


def _synced(data: bytes) -> int | None:
    """Where the first record behind the first line end begins, or None if more data are needed. A line
    with ``@`` two lines before one with ``+`` is a header: bases never begin with either."""
    at = data.find(b"\n") + 1
    while at:
        second = data.find(b"\n", at) + 1
        third = data.find(b"\n", second) + 1 if second else 0
        if not third or third >= len(data):
            return None
        if data[at:at + 1] == b"@" and data[third:third + 1] == b"+":
            return at
        at = second
    return None


def _part_records(files: fs.FileSystem, file: FastqFile) -> Iterator[pa.RecordBatch]:
    """``read_id, seq, qual`` of the records that begin in a part (behind its first byte, unless it is
    the first part; at its end included, since the next part leaves that one out)."""
    with files.open_input_file(file.path) as source:
        size = source.size()
        blocks = _inflated(source, _first_member(source, file.start, size) if file.start else 0, size)
        data, place, limit, synced, before, over = b"", 0, None, not file.start, 0, False
        while not over:
            parts, held = [data], len(data)
            # One block at a time behind the part's end, where only the last record is missing.
            while not over and held - len(data) < (BLOCK_BYTES if limit is None else 1):
                at, block = next(blocks, (size, None))
                if limit is None and at >= file.end:
                    limit = place + held
                if block is None:
                    over = True
                else:
                    parts.append(block)
                    held += len(block)
                    if limit is not None:
                        break
            data = b"".join(parts)
            if over and data and not data.endswith(b"\n"):
                data += b"\n"
            if not synced:
                start = _synced(data)
                if start is None:
                    continue
                data, place, synced = data[start:], place + start, True
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
            starts = np.concatenate([[0], ends[3::4]])[:len(ends) // 4] + place
            n = len(starts) if limit is None else int(np.searchsorted(starts, limit, "right"))
            if n:
                cut = int(ends[4 * n - 1])
                yield _parse(data[:cut], ends[:4 * n], file.name, before)
                data, place, before = data[cut:], place + cut, before + n
            if limit is not None and place > limit:
                return
        if synced and data.strip() and place <= limit:
            raise ValueError(f"{file.name}: the file ends inside a record")


def _cut(files: fs.FileSystem, found: list[FastqFile], split_bytes: int) -> list[FastqFile]:
    """Large block-gzip files in parts; only the head of a large file is read for this."""
    out = []
    for file in found:
        size = files.get_file_info(file.path).size
        if size > split_bytes:
            with files.open_input_file(file.path) as source:
                blocked = _member_size(source.read_at(min(size, MAX_MEMBER), 0), 0) is not None
            if blocked:
                n = -(-size // split_bytes)
                edges = [size * i // n for i in range(n)] + [size]
                out += [FastqFile(file.path, file.sample_id, file.lane, file.direction, i, a, b)
                        for i, (a, b) in enumerate(zip(edges, edges[1:]))]
                continue
        out.append(file)
    return out


class FastqReader(DataSourceReader):
    """Options choose samples, lanes and directions before any file is opened."""

    columns = ("sample_id", "lane", "direction")

    def __init__(self, options: dict):
        self.folder, self.split_bytes = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted: list[tuple[str, set]] = [(c, set(json.loads(options[c]))) for c in self.columns if c in options]

    def files(self) -> list[FastqFile]:
        return [f for f in _list_files(self.folder) if all(getattr(f, c) in values for c, values in self.wanted)]

    def partitions(self):
        return _cut(_filesystem(self.folder)[0], self.files(), self.split_bytes)

    def records(self, partition: FastqFile) -> Iterator[pa.RecordBatch]:
        files = _filesystem(self.folder)[0]
        return _records(files, partition) if partition.end is None else _part_records(files, partition)

    def read(self, partition: FastqFile):
        first = 0
        for part in self.records(partition):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(partition.sample_id), n), pa.repeat(pa.scalar(partition.lane, pa.int32()), n),
                pa.repeat(pa.scalar(partition.direction), n), pa.array(np.arange(first, first + n)),
                *part.columns, pa.repeat(pa.scalar(partition.name), n), pa.repeat(pa.scalar(partition.part, pa.int32()), n),
            ], names=PARTS.fieldNames())
            first += n


class PushingReader(FastqReader):
    """Filters of the query on these columns choose files, too.

    Spark keeps one reader per loaded table: a plan that filters one loaded table in two ways gets
    the files of the last filter for both. So this is for those who ask for it.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.wanted.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f


class CountReader(FastqReader):
    """Records of each part of the files that are cut."""

    def partitions(self):
        return [f for f in super().partitions() if f.end is not None]

    def read(self, partition: FastqFile):
        n = sum(part.num_rows for part in self.records(partition))
        yield (partition.sample_id, partition.lane, partition.direction, partition.name, partition.part, n)


def _side_by_side(sides: list[Iterator[pa.RecordBatch]]) -> Iterator[list[pa.RecordBatch | None]]:
    """Batches of both files cut to equal numbers of records; None where a file has ended."""
    heads = [next(side, None) for side in sides]
    while any(head is not None for head in heads):
        n = min(head.num_rows for head in heads if head is not None)
        yield [head if head is None else head.slice(0, n) for head in heads]
        heads = [None if head is None else head.slice(n) if head.num_rows > n else next(side, None)
                 for head, side in zip(heads, sides)]


class PairsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self):
        mates: dict[tuple[str, int], Mates] = {}
        for f in _list_files(self.folder):
            found = mates.setdefault((f.sample_id, f.lane), Mates(f.sample_id, f.lane, {}))
            if f.direction in found.files:
                raise ValueError(f"two files for one lane: {found.files[f.direction].name} and {f.name}")
            found.files[f.direction] = f
        return list(mates.values())

    def read(self, partition: Mates):
        files, _ = _filesystem(self.folder)
        sides = [_records(files, partition.files[d]) if d in partition.files else iter(()) for d in "FR"]
        first = 0
        for fwd, rev in _side_by_side(sides):
            one = rev if fwd is None else fwd
            n = one.num_rows
            nothing = pa.nulls(n, pa.string())
            if rev is None or fwd is None:
                error = pa.repeat(pa.scalar("missing_reverse" if rev is None else "missing_forward"), n)
            else:
                error = pc.if_else(pc.not_equal(fwd["read_id"], rev["read_id"]), pa.scalar("id_mismatch"),
                                   pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(partition.sample_id), n), pa.repeat(pa.scalar(partition.lane, pa.int32()), n),
                pa.array(np.arange(first, first + n)), one["read_id"],
                *(nothing if side is None else side[column] for side in (fwd, rev) for column in ("seq", "qual")),
                error,
            ], names=PAIRS.fieldNames())
            first += n


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "paired_fastq"

    def schema(self):
        return PARTS

    def reader(self, schema):
        return (PushingReader if self.options.get("push_filters") == "true" else FastqReader)(self.options)


class CountSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq_counts"

    def schema(self):
        return COUNTS

    def reader(self, schema):
        return CountReader(self.options)


class PairsSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq_pairs"

    def schema(self):
        return PAIRS

    def reader(self, schema):
        return PairsReader(self.options)


def read_fastq_casava(spark: SparkSession, path: str, direction: str | None = None, samples: list[str] | None = None,
                      lanes: list[int] | None = None, split_bytes: int = SPLIT_BYTES, push_filters: bool = False) -> DataFrame:
    """One row per read. A plain gzip file is one task, streamed in batches; a block-gzip file of more
    than ``split_bytes`` is several, and its parts are counted first, in a plan of their own.

    ``direction`` ("F" or "R"), ``samples`` and ``lanes`` leave the other files unopened. With
    ``push_filters`` so do the query's own filters on these columns, if the result is filtered in one way
    only (see ``PushingReader``); this turns on the push-down to Python sources in the session.
    """
    if push_filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(CountSource)
    chosen = {"direction": [direction] if direction else None, "sample_id": samples, "lane": lanes}
    options = {"split_bytes": str(split_bytes), "push_filters": str(push_filters).lower()} | {c: json.dumps(v) for c, v in chosen.items() if v is not None}
    reads = spark.read.format("paired_fastq").options(**options).load(path)
    if all(f.end is None for f in FastqReader(options | {"path": path}).partitions()):
        return reads.drop("part")
    # One row per part of a file.
    of_file = ["sample_id", "lane", "direction", "file"]
    counts = spark.read.format("fastq_counts").options(**options).load(path)
    before = counts.select(*of_file, "part", (F.sum("n").over(Window.partitionBy(*of_file).orderBy("part")) - F.col("n")).alias("_before"))
    return reads.join(F.broadcast(before), [*of_file, "part"], "left").withColumn(
        "read_no", F.col("read_no") + F.coalesce("_before", F.lit(0))).select(*DIRECTED_READS.fieldNames())


def read_fastq_pairs(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """One row per fragment, as ``pair_mates`` makes them from single reads, without a shuffle.

    Mates stand in the same order in their two files, so one task per sample and lane reads
    both side by side, each once. Two files for one sample, lane and direction are an error.

    With ``split_bytes`` block-gzip files of more bytes are read in parts, and mates are joined by their
    number: more tasks for a shuffle.
    """
    if split_bytes is not None:
        seen = set()
        for f in _list_files(path):
            if (f.sample_id, f.lane, f.direction) in seen:
                raise ValueError(f"two files for one lane: {f.name} and another")
            seen.add((f.sample_id, f.lane, f.direction))
        return pair_mates(read_fastq_casava(spark, path, split_bytes=split_bytes))
    spark.dataSource.register(PairsSource)
    return spark.read.format("fastq_pairs").load(path)
