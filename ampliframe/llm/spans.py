"""Substring dedup: runs of consecutive sentences that occurred before are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ampliframe.llm.common import _arrow_fields, boxed, join_rows, map_rows, plain, split_by, unboxed
from ampliframe.llm.hashing import NOT_SPACE, byte_class, range_codes, words_at
from ampliframe.sources.stage import persist_stage

#: A span is a run of at least so many sentences with at least so many words that no shorter one has with
#: the same begin, or with the same end: together they cover every repeated run that is long enough.
MIN_SENTENCES, MIN_WORDS = 3, 20
#: A sentence of more words than ``LONG`` counts as several, so that a passage of one or two very long
#: sentences also holds runs of several. It is cut behind words whose code, with that of the word
#: before, is the least within ``NEAR`` words: a passage is cut alike wherever it begins. Where
#: no such word comes for ``LONG`` words, as among equal words, every ``PIECE`` words.
LONG, PIECE, NEAR = 18, 9, 2

_ends, _closes = byte_class(b".!?"), byte_class(b"\"')]")


def sentences(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words of a UTF-8 text, the number of words before each sentence (and in all), and
    the byte where each sentence begins (and the text ends). A sentence ends behind a word with
    ``. ! ?`` or before a line break; together the sentences are the whole text."""
    codes, starts, ends = words_at(data, NOT_SPACE)
    n = len(codes)
    if not n:
        return codes, np.zeros(1, np.int64), np.array([len(data)])
    raw = np.frombuffer(data, np.uint8)
    last, before = raw[ends - 1], raw[np.maximum(ends - 2, starts)]
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    stop = _ends[last] | _closes[last] & _ends[before]
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    stop[-1] = True
    final = np.flatnonzero(stop)
    size = np.diff(np.concatenate([[-1], final]))
    place = np.arange(n) - np.repeat(final - size + 1, size)
    left = np.repeat(final, size) - np.arange(n)
    long = np.repeat(size, size) > LONG
    if long.any():
        inner = long & (place >= PIECE // 2) & (left >= PIECE // 2)
        stop |= _least(codes) & inner
        edge = np.flatnonzero(stop)
        since = np.arange(n) - np.repeat(np.concatenate([[-1], edge[:-1]]), np.diff(np.concatenate([[-1], edge])))
        whole = np.repeat(np.diff(np.concatenate([[-1], edge])), np.diff(np.concatenate([[-1], edge])))
        stop |= inner & (whole > LONG) & (since % PIECE == 0) & (whole - since >= PIECE // 2)
    first = np.concatenate([[0], np.flatnonzero(stop) + 1])
    return codes, first, np.concatenate([[0], starts[first[1:-1]], [len(data)]])


def _least(codes: np.ndarray) -> np.ndarray:
    """Which words have a code, mixed with that of the word before, under those of all within ``NEAR`` words."""
    mixed = codes.copy()
    mixed[1:] ^= codes[:-1] * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.ones(len(codes), bool)
    for d in range(1, NEAR + 1):
        out[d:] &= mixed[d:] < mixed[:-d]
        out[:-d] &= mixed[:-d] < mixed[d:]
    return out


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first, last, h1, h2``: for each sentence the shortest long enough runs that begin and that end with
    it, each run once, and a 128-bit key of the run's words, A-Z in lower case."""
    codes, at, _ = sentences(data)
    n = len(at) - 1
    first = np.arange(n)
    last = np.maximum(first + MIN_SENTENCES, np.searchsorted(at, at[:-1] + MIN_WORDS)) - 1
    first, last = first[last < n], last[last < n]
    # Of the runs that end with a sentence those that begin a shorter run are still to be added.
    end = np.arange(n)
    begin = np.minimum(end - MIN_SENTENCES + 1, np.searchsorted(at, at[1:] - MIN_WORDS, side="right") - 1)
    begin, end = begin[begin >= 0], end[begin >= 0]
    more = last[begin] != end
    first, last = np.concatenate([first, begin[more]]), np.concatenate([last, end[more]])
    other = (codes ^ (codes >> np.uint64(17))) * np.uint64(0xBF58476D1CE4E5B9)
    return (first, last, range_codes(codes, at[first], at[last + 1]).view(np.int64),
            range_codes(other, at[first], at[last + 1]).view(np.int64))


def _later(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of columns sorted by key (rows 0 and 1): which rows are not the first of their key, and for each
    row the place of the first."""
    new = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
    return ~new, np.maximum.accumulate(np.where(new, np.arange(rows.shape[1]), 0))


#: Order of texts: id (null last), hash of the text, place in it.
_ROWS = "h1 long, h2 long, id long, t long, first int, last int, earlier long"


def _span_rows(docs: DataFrame) -> DataFrame:
    """One row per span; ``earlier``: the id of an earlier text that holds it, if the same Arrow batch has
    one. Such a row needs no further search and gets a key of its own, so a span that a large
    share of all texts hold sends one row per batch to its key."""
    fields = pa.schema(_arrow_fields(docs.sparkSession, _ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, ids, ts = [], batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, value in enumerate(batch.column(2)):
                first, last, h1, h2 = spans(value.as_py().encode())
                if len(first):
                    parts.append(np.stack([h1, h2, np.full(len(first), ids[i]), np.full(len(first), ts[i]), first, last]))
            if not parts:
                continue
            rows = np.concatenate(parts, axis=1)
            rows = rows[:, np.lexsort(rows[[4, 3, 2, 1, 0]])]
            later, place = _later(rows)
            # Repeated rows are the same text.
            later &= ~((rows[2:5] == rows[2:5, place]).all(axis=0))
            earlier = rows[2, place]
            own = rows.copy()
            own[0, later], own[1, later] = rows[2, later] * 31 + rows[4, later], rows[3, later]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int32) if f.type == pa.int32() else c) for c, f in zip(own, fields)]
                + [pa.array(earlier, mask=~later)], schema=fields)

    return docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "_t", "text").mapInArrow(run, _ROWS)


#: Stands for a null id.
LAST_ID = (1 << 63) - 1


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, _t, first, last, earlier_doc``: the spans that are not the first of their key, in the order
    of ids (null last), text hashes and places; ``earlier_doc`` holds the span before them.

    One shuffle of hashes; a task reads its keys in order and keeps one row in mind.
    """
    schema = "id long, _t long, first int, last int, earlier long"
    fields = pa.schema(_arrow_fields(docs.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros((6, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            known = batch.column(6).is_valid().to_numpy(zero_copy_only=False)
            given = batch.column(6).fill_null(0).to_numpy()
            rows = np.concatenate([head, new], axis=1)
            skip = head.shape[1]
            later, place = _later(rows)
            later &= ~((rows[2:5] == rows[2:5, place]).all(axis=0))
            earlier = rows[2, place]
            later, earlier, own = later[skip:], earlier[skip:], rows[:, skip:]
            earlier = np.where(known, given, earlier)
            later |= known
            out = [own[2], own[3], own[4].astype(np.int32), own[5].astype(np.int32), earlier]
            yield pa.RecordBatch.from_arrays([pa.array(c[later], f.type) for c, f in zip(out, fields)], schema=fields)
            head = rows[:, place[-1]:place[-1] + 1]

    found = (_span_rows(docs).repartition("h1", "h2").sortWithinPartitions("h1", "h2", "id", "t", "first")
             .mapInArrow(run, schema))
    null_last = [F.when(F.col(c) != LAST_ID, F.col(c)).alias(n) for c, n in (("id", "doc_id"), ("earlier", "earlier_doc"))]
    return found.select(null_last[0], "_t", "first", "last", null_last[1])


def _removals(docs: DataFrame) -> DataFrame:
    """Per text with repeats: its repeated spans and texts that held them before."""
    return repeated_spans(docs).groupBy("doc_id", "_t").agg(
        F.collect_set(F.struct("first", "last")).alias("_spans"),
        F.array_sort(F.collect_set("earlier_doc")).alias("earlier_docs"))


def without(text: str, covered: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """The text without the covered sentences, and how many sentences it had and how many sentences
    and words it lost."""
    data = text.encode()
    _, words, at = sentences(data)
    gone = np.zeros(len(words) - 1, bool)
    for first, last in covered:
        gone[first:last + 1] = True
    kept = b"".join(data[a:b] for a, b, g in zip(at[:-1].tolist(), at[1:].tolist(), gone.tolist()) if not g)
    return (kept.decode() if len(gone) else text), len(gone), int(gone.sum()), int(np.diff(words)[gone].sum())


def span_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_sentences, n_removed, n_removed_words, earlier_docs, kept`` (text), one row per input
    row that loses sentences; a text that repeats nothing has no row.

    The shortest long enough runs from and up to every sentence are hashed, keys meet over the whole table, and a
    sentence goes if any repeated span that is not the first covers it. Repeated rows are one
    text. ``earlier_docs``: ids of texts that hold the removed spans and come before. Null or empty texts and
    texts shorter than a span lose nothing. Hashes are shuffled once, and texts once to
    their removals.
    """
    docs = plain(docs, key, text)
    removals = _removals(docs)
    removals = persist_stage(removals, "repeated-spans")
    hit = join_rows(split_by(docs, removals)[0], removals, "inner").select(
        "doc_id", "text", "earlier_docs", F.transform(
            "_spans", lambda s: F.array(s["first"], s["last"])).alias("_spans"))

    def work(rows):
        done = [without(t, s) for t, s in zip(rows["text"], rows["_spans"])]
        kept, n, gone, words = zip(*done) if done else ((), (), (), ())
        return {"doc_id": rows["doc_id"], "n_sentences": n, "n_removed": gone, "n_removed_words": words,
                "earlier_docs": rows["earlier_docs"], "kept": kept}

    return map_rows(hit.select("doc_id", "text", "earlier_docs", "_spans"), work, "doc_id long, n_sentences long, "
                    "n_removed long, n_removed_words long, earlier_docs array<long>, kept string")


def drop_repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows with the remaining text, other columns unchanged."""
    rows = boxed(docs, key, text)
    removals = _removals(plain(docs, key, text))
    joined = join_rows(rows, removals, "left").select("_row", "text", "_spans")
    cut = F.pandas_udf(lambda texts, covered: texts.combine(
        covered, lambda t, c: without(t, [tuple(x) for x in c])[0]), "string")
    spans_of = F.transform("_spans", lambda s: F.array(s["first"], s["last"]))
    changed = F.when(F.col("_spans").isNull(), F.col("_row").getField(text)).otherwise(
        cut("text", F.coalesce(spans_of, F.array().cast("array<array<int>>"))))
    return unboxed(joined, docs.columns, **{text: changed})
