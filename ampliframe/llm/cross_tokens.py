"""Alignment of two tokenizers' tokens over the same bytes, on Arrow tables.

Token lists are flattened with the number of their document, token lengths in bytes become end
offsets by a segmented cumulative sum, and a hash join on (document, end) finds the places where
tokens of both sides end. These cut a document into groups. A hash join on the group links the
tokens of both sides; ``group_by`` counts the links of a document and, over many documents, how many
hold an id pair. Spark adds up these partial counts and brings them back.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, functions as F

from ampliframe.llm.bpe import Codec, read_vocabulary
from ampliframe.llm.common import SLICE, _arrow_fields
from ampliframe.operators.partitioning import salted_join
from ampliframe.sources.stage import persist_stage

#: Texts of more characters are encoded by this library's own codec, whose matcher has no limit.
LONG_TEXT = 1 << 20
#: A batch with a group of more links than this counts equal tokens of a group before linking.
BIG_GROUP = 4096
#: Rows of partial counts that a task holds.
HELD_COUNTS = 1 << 20
#: Up to so many id pairs (16 bytes each) go to every executor; more are joined.
MAX_PAIRS = 1 << 21
PAIR_BITS = 32


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable
    Latin-1, else the next one from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Side A: a byte-level vocabulary in JSON whose merges rank by the id they make."""

    def __init__(self, content: bytes, pattern: str):
        model, alphabet = json.loads(content)["model"], byte_alphabet()
        ranks = {bytes(alphabet[c] for c in entry): i for entry, i in model["vocab"].items() if all(c in alphabet for c in entry)}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("merges do not rank by the id they make")
        # An entry that neither is a byte nor comes from a merge (a special token) is never encoded.
        ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i >= made[0]} if made else ranks
        reached = set(made)
        ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i in reached}
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks, self.pattern, self.own = ranks, pattern, None
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(t) if len(t) <= LONG_TEXT else self._long(t) for t in texts]

    def _long(self, text: str) -> list[int]:
        self.own = self.own or Codec(self.ranks, self.pattern)
        return np.frombuffer(self.own.encode(text), "<u4").tolist()


class PieceTokens:
    """Side B: pieces, with U+2581 for a space and ``<0xHH>`` for single bytes."""

    def __init__(self, content: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.tokens = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Side:
    """Tokens as Arrow arrays: their bytes, lengths, and decimal ids behind each separator."""

    def __init__(self, tokens: list[bytes], separators: list[str]):
        self.bytes, self.size = pa.array(tokens, pa.large_binary()), len(tokens)
        self.lengths = pa.array([len(t) for t in tokens], pa.int64())
        self.shown = [s + str(i) for s in separators for i in range(self.size)]


class Aligner:
    """Built once per Python worker."""

    def __init__(self, content_a: bytes, content_b: bytes, pattern: str):
        self.a, self.b = ByteTokens(content_a, pattern), PieceTokens(content_b)
        # A group begins with its first A token (at the text's start without a mark), B tokens follow.
        self.side_a, self.side_b = _Side(self.a.tokens, ["", ";", ","]), _Side(self.b.tokens, ["|", ","])
        self.shown = pa.array(self.side_a.shown + self.side_b.shown, pa.large_string())

    def encode(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        """Token lists of both sides; texts whose bytes either side changes have none."""
        spaced = [" " + t if t else "" for t in texts]
        lists = [pa.array(x, pa.large_list(pa.int32())) for x in (self.a.encode(spaced), self.b.encode([t or "" for t in texts]))]
        whole = np.ones(len(texts), bool)
        for side, ids in zip((self.side_a, self.side_b), lists):
            joined = side.bytes.take(ids.flatten())
            data, ends = memoryview(joined.buffers()[2] or b"").cast("B"), np.frombuffer(joined.buffers()[1], np.int64)
            cuts = ends[ids.offsets.to_numpy()]
            whole &= [data[i:j] == t.encode() for i, j, t in zip(cuts[:-1], cuts[1:], spaced)]
        if not whole.all():
            lists = [_emptied(x, whole) for x in lists]
        return tuple(lists)

    def align(self, a: pa.Array, b: pa.Array) -> dict[str, pa.Array | list]:
        n = len(a)
        flat, parent, key = zip(*(_ends(x, s.lengths) for x, s in ((a, self.side_a), (b, self.side_b))))
        ia, ib = (pa.array(np.arange(len(x))) for x in flat)
        both = pa.table({"key": key[0], "ia": ia}).join(pa.table({"key": key[1], "ib": ib}), "key", join_type="inner")
        group, cuts = [], []
        for side, place in ((0, "ia"), (1, "ib")):
            cut = np.zeros(len(flat[side]), np.int64)
            cut[both[place].to_numpy()] = 1
            cuts.append(cut)
            group.append(np.cumsum(cut) - cut)
        n_groups = int(cuts[0].sum())
        group_doc = parent[0][cuts[0] == 1]
        pairs = self._links(flat, group, n_groups)
        doc = group_doc[pairs["group"].to_numpy()]
        counted = pa.table({"doc": doc, "pair": pairs["pair"], "n": pairs["n"]}).group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")])
        at = counted["doc"].to_numpy()
        order = np.argsort(at.astype(np.int32), kind="stable")
        starts = pa.array(np.searchsorted(at[order], np.arange(n + 1)).astype(np.int32))
        pair, times = counted["pair"].to_numpy()[order], counted["n_sum"].to_numpy()[order]
        listed = [pa.ListArray.from_arrays(starts, pa.array(x)) for x in (
            (pair >> PAIR_BITS).astype(np.int32), (pair & ((1 << PAIR_BITS) - 1)).astype(np.int32), times)]
        return {"n_a": pc.list_value_length(a), "n_b": pc.list_value_length(b),
                "n_groups": np.bincount(group_doc, minlength=n), "n_links": np.bincount(at, counted["n_sum"].to_numpy(), n).astype(np.int64),
                "groups_sha256": self._digests(flat, parent, group, cuts, n), "a": listed[0], "b": listed[1], "times": listed[2]}

    def _links(self, flat, group, n_groups: int) -> pa.Table:
        """``group, pair, n``: linked ids, a pair may come up several times."""
        sizes = [np.bincount(g, minlength=n_groups) for g in group]
        if (sizes[0] * sizes[1]).max(initial=0) <= BIG_GROUP:
            tables = [pa.table({"group": g, "id": f}) for g, f in zip(group, flat)]
            linked = tables[0].join(tables[1].rename_columns(["group", "other"]), "group", join_type="inner", use_threads=False)
            times = np.ones(len(linked), np.int64)
        else:
            tables = [pa.table({"group": g, "id": f, "n": np.ones(len(g), np.int64)}).group_by(["group", "id"], use_threads=False).aggregate([("n", "sum")])
                      for g, f in zip(group, flat)]
            linked = tables[0].join(tables[1].rename_columns(["group", "other", "m"]), "group", join_type="inner", use_threads=False)
            times = linked["n_sum"].to_numpy() * linked["m"].to_numpy()
        pair = linked["id"].to_numpy().astype(np.int64) << PAIR_BITS | linked["other"].to_numpy()
        return pa.table({"group": linked["group"], "pair": pair, "n": times})

    def _digests(self, flat, parent, group, cuts, n: int) -> list[str]:
        """Tokens in order of group and side, each with the separator before it, as one string array whose
        text buffer is cut by document."""
        first = [np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool) for g in group]
        opens = np.concatenate([[True], parent[0][1:] != parent[0][:-1]]) if len(parent[0]) else np.zeros(0, bool)
        size_a, size_b = self.side_a.size, self.side_b.size
        shown_a = flat[0].to_numpy() + size_a * np.where(opens, 0, np.where(first[0], 1, 2))
        shown_b = flat[1].to_numpy() + 3 * size_a + size_b * np.where(first[1], 0, 1)
        ends_a, ends_b = (np.cumsum(np.bincount(g, minlength=int(cuts[0].sum()))) for g in group)
        place_a = np.arange(len(shown_a)) + (np.concatenate([[0], ends_b])[group[0]] if len(shown_a) else 0)
        place_b = np.arange(len(shown_b)) + (ends_a[group[1]] if len(shown_b) else 0)
        mixed, owner = np.zeros(len(shown_a) + len(shown_b), np.int64), np.zeros(len(shown_a) + len(shown_b), np.int64)
        for place, shown, own in ((place_a, shown_a, parent[0]), (place_b, shown_b, parent[1])):
            mixed[place], owner[place] = shown, own
        text = self.shown.take(pa.array(mixed))
        data, ends = memoryview(text.buffers()[2] or b"").cast("B"), np.frombuffer(text.buffers()[1], np.int64)
        at = ends[np.searchsorted(owner, np.arange(n + 1))]
        return [hashlib.sha256(data[i:j]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:])]


def _emptied(lists: pa.Array, keep: np.ndarray) -> pa.Array:
    """The lists not marked ``keep`` become empty."""
    lengths = np.where(keep, pc.list_value_length(lists).to_numpy(), 0)
    kept = lists.flatten().filter(pa.array(np.repeat(keep, np.diff(lists.offsets.to_numpy()))))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)])), kept)


def _ends(lists: pa.Array, lengths: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Flat ids, their documents, and keys of (document, offset behind the token)."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    total = np.concatenate([[0], pc.cumulative_sum(lengths.take(flat)).to_numpy()])
    before = total[lists.offsets.to_numpy()[:-1]]
    return flat, parent, pa.array((parent << 40) + total[1:] - before[parent])


_aligners: dict[tuple, Aligner] = {}


class SharedAligner:
    """For use inside tasks: the files are broadcast (size checked), tables are built once per worker."""

    def __init__(self, spark, path_a: str, path_b: str, pattern: str):
        self.files, self.pattern = spark.sparkContext.broadcast((read_vocabulary(path_a), read_vocabulary(path_b))), pattern

    def get(self) -> Aligner:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        name = (self.pattern, *(hashlib.sha256(x).hexdigest() for x in self.files.value))
        if name not in _aligners:
            _aligners[name] = Aligner(*self.files.value, self.pattern)
        return _aligners[name]


ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "a array<int>, b array<int>, times array<long>")


def align_texts(docs: DataFrame, path_a: str, path_b: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One stored row per document: the counts, the digest of its groups, and its id pairs (``a``, ``b``) with the
    number of links of each. A map without shuffle."""
    spark = docs.sparkSession
    shared, schema = SharedAligner(spark, path_a, path_b, pattern), pa.schema(_arrow_fields(spark, ALIGNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or shared.get()
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                out = aligner.align(*aligner.encode(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), *(pa.array(out[f.name]).cast(f.type) for f in schema if f.name in out)], schema=schema)

    rows = docs.select(F.struct("*").alias("_row")).select(
        F.monotonically_increasing_id().alias("row"), F.col("_row").getField(key).cast("long").alias("doc_id"),
        F.col("_row").getField(text).alias("text"))
    return persist_stage(rows.mapInArrow(run, ALIGNED), "aligned-tokens")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n``: how many documents hold the pair linked. Counts are partial sums of tasks, added by Spark."""
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            a, b = batch.column(0).flatten(), batch.column(1).flatten()
            held.append(pa.table([a, b, pa.array(np.ones(len(a), np.int64))], schema=schema))
            rows += len(a)
            if rows > 4 * HELD_COUNTS:
                held = [summed(held)]
                rows = len(held[0])
                if rows > HELD_COUNTS:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from summed(held).combine_chunks().to_batches()

    return aligned.select("a", "b").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of a bounded number of pairs go to the executors and are searched there."""
    spark = aligned.sparkSession
    table = counts.select((F.shiftleft(F.col("a").cast("long"), PAIR_BITS) + F.col("b")).alias("pair"),
                          (F.col("n") * F.when(F.col("n") == F.col("best"), 1).otherwise(-1)).alias("n")).toArrow()
    pair, n = table["pair"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(pair)
    shared = spark.sparkContext.broadcast((pair[order], n[order]))  # n below 0: not its A id's highest
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    columns = ALIGNED.split(", ")[:7] + ["n_best long", "count_sum long"]
    schema = pa.schema(_arrow_fields(spark, ", ".join(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signed = shared.value
        for batch in batches:
            a, b, times = (batch.column(batch.schema.get_field_index(x)).flatten().to_numpy() for x in ("a", "b", "times"))
            owner = pc.list_parent_indices(batch.column(batch.schema.get_field_index("a"))).to_numpy()
            found = signed[np.searchsorted(known, a.astype(np.int64) << PAIR_BITS | b)] if len(a) else np.zeros(0, np.int64)
            sums = []
            for value in (np.where(found > 0, times, 0), np.abs(found) * times):
                total = np.concatenate([[0], np.cumsum(value)])  # in whole numbers
                cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                sums.append(pa.array(total[cuts[1:]] - total[cuts[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(x)) for x in names] + sums, schema=schema)

    return aligned.mapInArrow(run, ", ".join(columns)).drop("row")


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same for any number of pairs, by a salted join and sums per document row."""
    links = aligned.select("row", F.inline(F.arrays_zip("a", "b", "times")))
    sums = salted_join(links, counts, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = {x: F.coalesce(x, F.lit(0)).cast("long") for x in ("n_best", "count_sum")}
    return aligned.drop("a", "b", "times").join(sums, "row", "left").withColumns(zero).drop("row")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, pattern: str, max_pairs: int = MAX_PAIRS,
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``, one row per input row.

    A encodes a space and the text by a byte-level vocabulary, B the text by pieces (and adds the space
    itself), both without special tokens. Places where tokens of both end cut the bytes into groups; all A-B
    pairs of tokens in a group are links. The count of an id pair is the number of documents (rows) that hold it
    linked; ``n_best`` counts links whose pair has the highest count of its A id (ties included),
    ``count_sum`` adds the counts over links.

    * Null and empty texts, and texts whose bytes a tokenizer changes, have zeros and an empty digest.
    * Repeated rows, shared and null ids are documents of their own. No rows: no rows.
    * Very long texts are aligned whole; memory follows ``SLICE`` texts. Other columns are ignored.
    """
    aligned = align_texts(docs, path_a, path_b, pattern, key, text)
    counts = persist_stage(pair_counts(aligned), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("best"))  # at most one row per entry of A
    counts = counts.join(F.broadcast(best), "a")
    return _looked_up(aligned, counts) if counts.count() <= max_pairs else _joined(aligned, counts)
