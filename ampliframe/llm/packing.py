"""Token-ID output: documents packed into rows of equal length by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ampliframe.llm.bpe import SharedCodec
from ampliframe.llm.common import _arrow_fields, plain
from ampliframe.sources.stage import persist_stage

#: Tokens and pieces that are packed together; a task packs its documents in such blocks.
BLOCK_TOKENS = 4_000_000
BLOCK_PIECES = 65_536

ROWS = ("pack_id long, ids binary, n_tokens int, doc_ids array<long>, part_nos array<int>, "
        "cu_seqlens array<int>, position_resets array<int>, position_starts array<long>")


class Capacities:
    """Segment tree over the free space of open rows: how many rows have each size below a node."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: dict[int, list[int]] = {}

    def put(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._add(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least free space of at least ``size``, removed; None if there is none."""
        node = self.base + size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1  # up until a neighbour to the right holds rows
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node + (not self.count[2 * node])
        free = node - self.base
        self._add(free, -1)
        return free, self.rows[free].pop()

    def _add(self, free: int, change: int) -> None:
        node = self.base + free
        while node:
            self.count[node] += change
            node >>= 1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of at most ``length`` tokens as lists of places in ``sizes`` (each at most ``length``):
    the largest first, each into the fullest row it still fits in."""
    open_rows, rows = Capacities(length), []
    for place in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[place]
        found = open_rows.take(size)
        if found is None:
            free, row = length, len(rows)
            rows.append([])
        else:
            free, row = found
        rows[row].append(place)
        open_rows.put(free - size, row)
    return rows


def split_lossless(ids: np.ndarray, length: int) -> list[np.ndarray]:
    """Pieces of at most ``length`` that put together are the document again."""
    return [ids[i:i + length] for i in range(0, len(ids), length)]


def position_ids(cu_seqlens: list[int], length: int, starts: list[int] | None = None) -> np.ndarray:
    """Positions inside each segment, zero behind the last one; with ``starts``, counted on through
    the pieces of a split document."""
    out = np.zeros(length, np.int64)
    for i, (a, b) in enumerate(zip(cu_seqlens, cu_seqlens[1:])):
        out[a:b] = np.arange(b - a) + (starts[i] if starts else 0)
    return out


def packed_rows(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, length: int = 2048,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``length`` token ids; every document, closed by ``end_id``, lies in them whole.

    ``ids``: the row as little-endian unsigned integers (16 bits if the vocabulary allows, else
    32), filled up with ``end_id`` behind ``n_tokens``. ``cu_seqlens``: cumulative segment
    lengths from 0. ``position_resets``: the columns where positions start again from 0;
    ``position_starts``: the place of each segment in its document. ``doc_ids``, ``part_nos``:
    whose segment it is. A document longer than a row becomes several pieces in order.

    A map without a shuffle: a task packs its documents in blocks of bounded size, so only the
    last rows of a block are partly empty. Null and empty texts are one ``end_id``; repeated
    rows are packed as often as they occur; an empty table gives no row.
    """
    shared = SharedCodec(docs.sparkSession, vocabulary, pattern)
    fields = pa.schema(_arrow_fields(docs.sparkSession, ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 33
        codec = shared.get()
        width = "<u2" if max(end_id, len(codec.vocabulary.tokens) - 1) < 1 << 16 else "<u4"
        filler, pieces, tokens, made = np.array([end_id], width).tobytes(), [], 0, 0

        def flush():
            nonlocal pieces, tokens, made
            sizes = [len(p[2]) // len(filler) for p in pieces]
            for rows in _chunks(best_fit_decreasing(sizes, length), 512):
                yield _batch(first + made, rows, pieces, sizes, length, filler, fields)
                made += len(rows)
            pieces, tokens = [], 0

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(np.frombuffer(codec.encode(value.as_py()), "<u4"), end_id).astype(width)
                pieces += [(doc, no, piece.tobytes()) for no, piece in enumerate(split_lossless(ids, length))]
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS or len(pieces) >= BLOCK_PIECES:
                    yield from flush()
        yield from flush()

    return plain(docs, key, text).select("doc_id", "text").mapInArrow(run, ROWS)


def _chunks(rows: list, size: int) -> Iterator[list]:
    for i in range(0, len(rows), size):
        yield rows[i:i + size]


def _batch(number: int, rows: list[list[int]], pieces: list[tuple], sizes: list[int], length: int, filler: bytes,
           fields: pa.Schema) -> pa.RecordBatch:
    """Rows (places in ``pieces``) numbered from ``number``, a column at a time; ``filler`` is one id's bytes."""
    order, per_row = [i for row in rows for i in row], np.array([len(row) for row in rows])
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    before = np.concatenate([[0], np.cumsum([sizes[i] for i in order])])
    n_tokens, resets = np.diff(before[offsets]), before[:-1] - np.repeat(before[offsets[:-1]], per_row)
    parts = np.array([pieces[i][1] for i in order])
    ids = [b"".join([pieces[i][2] for i in row]) + filler * (length - n) for row, n in zip(rows, n_tokens.tolist())]

    def lists(values, name: str, offsets=offsets) -> pa.ListArray:
        kind = fields.field(name).type
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind.value_type), type=kind)

    return pa.RecordBatch.from_arrays([
        pa.array(np.arange(number, number + len(rows))), pa.array(ids, pa.binary()), pa.array(n_tokens, pa.int32()),
        lists([pieces[i][0] for i in order], "doc_ids"), lists(parts, "part_nos"),
        lists(np.insert(resets, offsets[1:], n_tokens), "cu_seqlens", offsets + np.arange(len(offsets))),
        lists(resets, "position_resets"), lists(parts * length, "position_starts")], schema=fields)


def write_packed(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, length: int = 2048,
                 path: str | None = None) -> DataFrame:
    """:func:`packed_rows`, written as Parquet (to ``path`` or the shared folder) and read back."""
    return persist_stage(packed_rows(docs, vocabulary, pattern, end_id, length), "packed", path)
