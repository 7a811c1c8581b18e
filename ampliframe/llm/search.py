"""Ranked lexical search, term at a time, with a limit on accumulators.

Documents are cut into segments of bounded size, each an inverted file of the terms that items
use. In a segment the terms of an item are taken rarest first. An accumulator (the partial score
of a document) is created only while the bounds of the terms still to come could lift a document
without one to the k-th partial score; from there on only documents that have one are updated,
exactly. The best ``k`` of a segment are among its accumulators, and the best ``k`` of all are among
those of the segments.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ampliframe.llm.common import _arrow_fields
from ampliframe.operators.partitioning import global_index
from ampliframe.sources.stage import persist_stage

#: Terms in UTF-8: digits, letters and every byte of other characters; A-Z in lower case first.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A segment is closed at so many postings or documents.
SEGMENT_POSTINGS, SEGMENT_DOCS = 1 << 20, 1 << 15
#: Items that are searched for at a time; their terms go to every executor.
ITEMS_PER_PASS, MAX_ITEM_BYTES = 5_000, 64 << 20
SALTS = 64

SEGMENT = ("n_docs long, n_terms long, docs array<long>, lengths array<long>, terms array<int>, sizes array<int>, "
           "places array<int>, counts array<int>")


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


class _Segment:
    """Postings in the making."""

    def __init__(self):
        self.n_docs = self.n_terms = 0
        self.docs, self.lengths, self.term, self.place, self.count = [], [], [], [], []

    def add(self, doc, words: list[bytes], known: dict[bytes, int]) -> None:
        self.n_docs += 1
        self.n_terms += len(words)
        found = [(known[w], n) for w, n in Counter(words).items() if w in known]
        if found:
            self.place += [len(self.docs)] * len(found)
            self.docs.append(doc)
            self.lengths.append(len(words))
            self.term += [t for t, _ in found]
            self.count += [n for _, n in found]

    def full(self) -> bool:
        return len(self.term) >= SEGMENT_POSTINGS or len(self.docs) >= SEGMENT_DOCS

    def row(self) -> dict:
        term = np.array(self.term, np.int32)
        order = np.argsort(term, kind="stable")
        terms, sizes = np.unique(term, return_counts=True)
        values = (self.n_docs, self.n_terms, self.docs, self.lengths, terms, sizes,
                  np.array(self.place, np.int32)[order], np.array(self.count, np.int32)[order])
        return {name.split()[0]: [v] for name, v in zip(SEGMENT.split(", "), values)}


def index_segments(docs: DataFrame, known: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted files over the ``known`` terms (term: number), every document in one of them; also how many
    documents have a term at all, and how many terms they have. A map without shuffle, stored."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)
    schema = pa.schema(_arrow_fields(spark, SEGMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, segment = shared.value, _Segment()
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(value.as_py())
                if words:
                    segment.add(doc, words, terms)
                if segment.full():
                    yield pa.RecordBatch.from_pydict(segment.row(), schema=schema)
                    segment = _Segment()
        if segment.n_docs:
            yield pa.RecordBatch.from_pydict(segment.row(), schema=schema)

    rows = docs.select(F.struct("*").alias("_row")).select(
        F.col("_row").getField(key).cast("long").alias("doc_id"), F.col("_row").getField(text).alias("text"))
    return persist_stage(rows.mapInArrow(run, SEGMENT), "search-segments")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best_of_segment(scores: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the accumulators left after all terms, and how many accumulators were made.

    ``scores`` holds per term, rarest first, the places of its documents and what it adds to them;
    ``least`` is a score that ``k`` documents of other segments already reach.
    """
    total, made, creating = np.zeros(size, np.int64), np.zeros(size, bool), True
    ahead = np.cumsum([int(add.max(initial=0)) for _, add in scores][::-1])[::-1]
    for (places, add), rest in zip(scores, ahead):
        if creating:
            kth, partial = least, total[made]
            if len(partial) >= k:
                kth = max(kth, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            creating = int(rest) >= kth
        if creating:
            made[places] = True
        else:
            has = made[places]
            places, add = places[has], add[has]
        total[places] += add
    left = np.flatnonzero(made & (total > 0))
    return left, total[left], int(made.sum())


def _order(row: tuple) -> tuple:
    score, doc = row
    return -score, doc is None, doc or 0


def _search(segments: DataFrame, items: dict[int, list[int]], weights: dict[int, tuple[int, int]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item_no, doc_id, score``: the best ``k`` per item of each task."""
    spark = segments.sparkSession
    shared = spark.sparkContext.broadcast((items, weights))
    schema = pa.schema([("item_no", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                _scan(batch.slice(at, 1), asked, weight, best)
        rows = [(item, doc, score) for item, found in best.items() for score, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=schema)

    def _scan(row: pa.RecordBatch, asked, weight, best) -> None:
        _, _, docs, lengths, terms, sizes, places, counts = (row.column(i)[0] for i in range(row.num_columns))
        lengths, sizes, places, counts = (x.values.to_numpy(zero_copy_only=False) for x in (lengths, sizes, places, counts))
        docs, terms = docs.as_py(), terms.as_py()
        # Python's integers: the product may leave 64 bits on the way.
        m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
        tf = counts.astype(np.int64)
        add = 1_000_000_000 * tf // (1000 * tf + 8 * m[places])
        ends = np.cumsum(sizes)
        postings = {}
        for term, size, end in zip(terms, sizes.tolist(), ends.tolist()):
            part = slice(end - size, end)
            postings[term] = places[part], add[part] * weight[term][0]
        for item, wanted in asked.items():
            here = sorted((weight[t][1], t) for t in wanted if t in postings)
            if not here:
                continue
            before = best.get(item, [])
            least = before[k - 1][0] if len(before) >= k else 1
            left, scores, _ = best_of_segment([postings[t] for _, t in here], len(docs), k, least)
            if len(left) > k:
                good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                left, scores = left[good], scores[good]
            found = before + [(s, docs[p]) for s, p in zip(scores.tolist(), left.tolist())]
            best[item] = sorted(found, key=_order)[:k]

    return segments.mapInArrow(run, "item_no long, doc_id long, score long")


def _top(rows: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item its ``k`` best documents with a score above 0.

    A term weighs ``floor(1000 ln((2N + 2) / (2df + 1)))`` and adds, once per item, its weight times
    ``1000000000 tf div (1000 tf + 8 m)`` with ``m = 10 + 90 n N div L``. Equal scores stand by ascending
    ``doc_id``, null last.

    * Null, empty and term-free texts are no documents (not in N); items without a term, or whose terms no
      document holds, have no rows. No documents or no items: no rows.
    * Repeated document rows are documents of their own, each may be ranked; equal item rows count once,
      different texts under one ``item_id`` (or under null) are items of their own.
    * Very long texts are read whole; other columns are ignored.

    All documents are read once per ``ITEMS_PER_PASS`` items: an indexing map, counts of the terms, and a
    map over the stored segments, whose best rows (at most ``k`` an item and task) are shuffled.
    """
    spark = docs.sparkSession
    boxed = items.select(F.struct("*").alias("_row")).select(
        F.col("_row").getField(item_key).alias("item_id"), F.coalesce(F.col("_row").getField(item_text), F.lit("")).alias("item_text"))
    numbered = persist_stage(global_index(boxed.distinct(), ["item_id", "item_text"], "item_no"), "search-items")
    n_items, parts = numbered.count(), []
    for first in range(0, n_items, ITEMS_PER_PASS):
        some = numbered.filter(F.col("item_no").between(first, first + ITEMS_PER_PASS - 1))
        size = some.agg(F.sum(F.octet_length("item_text"))).first()[0]
        if size > MAX_ITEM_BYTES:
            raise ValueError(f"{ITEMS_PER_PASS} items hold {size} bytes of text; lower ITEMS_PER_PASS")
        asked, known = {}, {}
        for row in some.select("item_no", "item_text").collect():
            asked[row.item_no] = [known.setdefault(t, len(known)) for t in dict.fromkeys(terms_of(row.item_text))]
        segments = index_segments(docs, known, key, text)
        n_docs, n_terms = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            break
        # One row per term of the items.
        held = dict(segments.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy("terms").agg(F.sum("sizes")).collect())
        weights = {t: (term_weight(n_docs, df), df) for t, df in held.items()}
        parts.append(_search(segments, asked, weights, n_docs, n_terms, k))
    if not parts:
        parts = [spark.createDataFrame([], "item_no long, doc_id long, score long")]
    found = reduce(DataFrame.unionAll, parts).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    found = _top(_top(found, k, "item_no", "_salt").drop("rank", "_salt"), k, "item_no")
    return found.join(numbered, "item_no").select("item_id", "rank", "doc_id", "score")
