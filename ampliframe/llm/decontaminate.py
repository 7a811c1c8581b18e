"""Benchmark decontamination: SimHash over item-sized windows, Hamming blocks, exact check."""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ampliframe.llm.common import boxed, map_rows, plain, unboxed, without_rows
from ampliframe.llm.hashing import WORD_LIKE, distinct, run_codes, word_codes
from ampliframe.sources.stage import persist_stage

SHINGLE = 5
THRESHOLD = 0.8
#: Fingerprint of 128 bits in 16 blocks. Two windows with weighted similarity 0.8 differ in 19
#: bits on average (standard deviation 4), unrelated ones in 64 (6). A distance of at most 31
#: leaves at least one of the 16 blocks with at most one wrong bit.
BITS, BLOCKS, RADIUS = 128, 16, 31
#: Items whose index is sent to the executors at a time; a larger benchmark takes several passes.
ITEMS_PER_PASS = 20_000
#: Characters of one pass's items, checked before the index is sent.
MAX_PASS_CHARS = 64_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> np.ndarray:
    """Codes of the words: runs of ASCII letters, digits, underscores and all non-ASCII characters."""
    return word_codes(text, WORD_LIKE)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 / -1 per fingerprint bit of each shingle."""
    second = (hashes ^ _ODD) * np.uint64(0xBF58476D1CE4E5B9)
    second ^= second >> np.uint64(31)
    both = np.stack([hashes, second], 1).view(np.uint8)
    return np.unpackbits(both, axis=1).astype(np.float32) * 2 - 1


def _fingerprints(hashes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` shingles, as 16 bytes each."""
    total = np.cumsum(np.vstack([np.zeros((1, BITS)), _signs(hashes) * weights[:, None]]), axis=0, dtype=np.float64)
    return np.packbits(total[size:] - total[:-size] > 0, axis=1)


class Index:
    """Items by number of words, with their shingle weights, fingerprints and Hamming blocks.

    ``items`` may be a part of a benchmark: ``n_items`` is then the number of its items with words, and
    ``shared`` in how many of them each shingle is that several hold."""

    def __init__(self, items: list[tuple[int, str]], n_items: int | None = None, shared: dict[int, int] | None = None):
        found = [(i, words_of(t)) for i, t in items]
        found = [(i, c) for i, c in found if len(c)]
        self.kinds = sorted({min(SHINGLE, len(c)) for _, c in found})
        per_item = [(i, len(c), min(SHINGLE, len(c)), run_codes(c, min(SHINGLE, len(c)))) for i, c in found]
        held = Counter(int(h) for x in per_item for h in set(x[3].tolist()))
        if shared is not None:
            held = {**dict.fromkeys(held, 1), **shared}
        n_items = len(per_item) if n_items is None else n_items
        # Weight of a shingle: rarer among the items counts more; one outside the benchmark
        # counts as one that a single item holds.
        self.top = 1.0 + math.log(max(n_items, 1))
        self.weight = {h: 1.0 + math.log(n_items / n) for h, n in held.items()}
        self.weighted = np.array(sorted(self.weight), np.uint64)
        self.known = {k: np.array(sorted({h for x in per_item if x[2] == k for h in x[3].tolist()}), np.uint64)
                      for k in self.kinds}
        self.sizes: dict[tuple[int, int], dict] = {}
        for k, n in sorted({(x[2], x[1]) for x in per_item}):
            group = [x for x in per_item if (x[2], x[1]) == (k, n)]
            prints = np.vstack([_fingerprints(x[3], self.weights(x[3]), len(x[3])) for x in group])
            near = np.zeros((BLOCKS, 256, len(group)), bool)  # block value -> items within one bit
            flips = np.array([0, *(1 << np.arange(8))], np.uint8)
            for b in range(BLOCKS):
                for flip in flips:
                    near[b, prints[:, b] ^ flip, np.arange(len(group))] = True
            holders: dict[int, list[int]] = {}
            for j, x in enumerate(group):
                for h in set(x[3].tolist()):
                    holders.setdefault(h, []).append(j)
            self.sizes[k, n] = {"ids": [x[0] for x in group], "prints": prints, "near": near,
                                "bags": [Counter(x[3].tolist()) for x in group],
                                "known": np.array(sorted(holders), np.uint64)}

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.top)
        for i in np.flatnonzero(_member(hashes, self.weighted)):
            out[i] = self.weight[int(hashes[i])]
        return out

    def similarity(self, window: np.ndarray, bag: Counter) -> float:
        """Weighted Jaccard similarity of two bags of shingles."""
        other = Counter(window.tolist())
        same = sum(self.weight[h] * min(n, other[h]) for h, n in bag.items() if h in other)
        both = sum(self.weight.get(h, self.top) * max(n, bag.get(h, 0)) for h, n in other.items()) + sum(
            self.weight[h] * n for h, n in bag.items() if h not in other)
        return same / both if both else 0.0

    def matches(self, text: str) -> dict[int, tuple[float, int, int, int]]:
        """Item -> (similarity, first word, number of words, matching windows), the best window first."""
        codes, best = words_of(text), {}
        for k in self.kinds:
            hashes = run_codes(codes, k)
            hit = np.flatnonzero(_member(hashes, self.known[k]))
            if not len(hit):
                continue
            weights = self.weights(hashes)
            for (kind, n), group in self.sizes.items():
                if kind != k:
                    continue
                if n > len(codes):  # the whole document is its one window
                    if _member(hashes[hit], group["known"]).any():
                        self._search(hashes, weights, 0, len(hashes), len(codes), group, best)
                    continue
                # A window without a shingle of the group's items has similarity 0 to all of them, so
                # fingerprints are made only for stretches of windows that hold one.
                own = hit[_member(hashes[hit], group["known"])]
                width = n - k + 1
                for first, last in _stretches(own, width, len(hashes)):
                    self._search(hashes[first:last], weights[first:last], first, width, n, group, best)
        return best

    def _search(self, hashes, weights, offset, width, n_words, group, best) -> None:
        prints = _fingerprints(hashes, weights, width)
        candidates = group["near"][0][prints[:, 0]]
        for b in range(1, BLOCKS):
            candidates = candidates | group["near"][b][prints[:, b]]
        windows, items = np.nonzero(candidates)
        apart = np.bitwise_count(prints[windows] ^ group["prints"][items]).sum(axis=1)
        for w, j in zip(windows[apart <= RADIUS].tolist(), items[apart <= RADIUS].tolist()):
            similar = self.similarity(hashes[w:w + width], group["bags"][j])
            if similar >= THRESHOLD - 1e-12:
                item = group["ids"][j]
                old = best.get(item, (0.0, 0, 0, 0))
                new = (similar, offset + w, n_words) if similar > old[0] else old[:3]
                best[item] = (*new, old[3] + 1)


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[place] == values


def _stretches(hits: np.ndarray, width: int, n: int) -> list[tuple[int, int]]:
    """Ranges of shingles that cover every window of ``width`` shingles with a hit in it; long
    ranges are cut into overlapping ones of bounded size."""
    out: list[list[int]] = []
    for h in hits.tolist():
        a, b = max(0, h - width + 1), min(n, h + width)
        if out and a <= out[-1][1] - width + 1:
            out[-1][1] = b
        else:
            out.append([a, b])
    step = 4096
    return [(s, min(b, s + step + width - 1)) for a, b in out if b - a >= width
            for s in range(a, b - width + 1, step)]


_indexes: dict[str, Index] = {}


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words, n_windows``: one row per document and
    benchmark item that some item-sized window of the document matches; clean documents have none.

    Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z in lower case. Every window with as many words as an item
    (or the whole document, if that is shorter) gets a SimHash of its 5-word shingles (shorter items: one shingle of all words). The Hamming
    blocks yield all pairs within ``RADIUS`` bits, whose weighted similarity is then computed
    exactly and compared with ``THRESHOLD``. Null or empty texts and items match nothing; items
    with equal text all match; repeated document rows repeat their rows.

    The documents are mapped without a shuffle, once per ``ITEMS_PER_PASS`` items; what goes to
    the executors per pass is checked against ``MAX_PASS_CHARS``.
    """
    spark = docs.sparkSession
    items = persist_stage(benchmark.select(F.col(item).cast("long").alias("item_id"),
                                           F.col(item_text).alias("text")).dropna().distinct(), "items")
    passes = max(1, -(-items.count() // ITEMS_PER_PASS))
    # Weights are those of the whole benchmark, also if it takes several passes.
    weights = spark.sparkContext.broadcast(_shared_shingles(items) if passes > 1 else (None, None))
    items = items.withColumn("_pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    sizes = items.groupBy("_pass").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
    if sizes > MAX_PASS_CHARS:
        raise ValueError(f"a pass of {ITEMS_PER_PASS} items holds {sizes} characters; lower ITEMS_PER_PASS")
    found = None
    for number in range(passes):
        block = [(r["item_id"], r["text"]) for r in
                 items.filter(F.col("_pass") == number).orderBy("item_id", "text").collect()]
        part = _search(plain(docs, key, text), spark.sparkContext.broadcast(block), weights)
        found = part if found is None else found.unionAll(part)
    return found


def _shared_shingles(items: DataFrame) -> tuple[int, dict[int, int]]:
    """How many items have words, and in how many of them each shingle is that several hold."""
    def work(rows):
        found = [words_of(t) for t in rows["text"]]
        sets = [distinct(run_codes(c, min(SHINGLE, len(c)))) for c in found if len(c)]
        return {"h": np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64), "_first": [
            i == 0 for s in sets for i in range(len(s))]}

    shingles = persist_stage(map_rows(items.select("text"), work, "h long, _first boolean"), "item-shingles")
    several = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return shingles.filter("_first").count(), {r["h"] % (1 << 64): r["n"] for r in several.collect()}


def _search(docs: DataFrame, block, weights) -> DataFrame:
    name = uuid.uuid4().hex

    def work(rows):
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = Index(block.value, *weights.value)
        index, out = _indexes[name], []
        for doc, t, text in zip(rows["doc_id"], rows["_t"], rows["text"]):
            out += [(doc, t, item, *found) for item, found in sorted(index.matches(text).items())]
        columns = list(zip(*out)) or [()] * 7
        return dict(zip(("doc_id", "_t", "item_id", "similarity", "first_word", "n_words", "n_windows"), columns))

    return map_rows(docs.select("doc_id", "_t", "text"), work, "doc_id long, _t long, item_id long, "
                    "similarity double, first_word long, n_words long, n_windows long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows that match no benchmark item, unchanged."""
    bad = persist_stage(contaminated(docs, benchmark, key, text).select("doc_id", "_t").distinct(), "contaminated")
    rows = boxed(docs, key, text)
    return unboxed(without_rows(rows, bad), docs.columns)
