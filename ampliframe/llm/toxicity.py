"""Toxicity by multiple-instance learning: a text is toxic if one of its sentences is.

Sentence ``j`` with words ``W_j`` has the chance ``p_j = sigmoid(bias + sum of the word weights)``;
the text's chance is the noisy-or ``1 - prod(1 - p_j)``. Only texts carry labels, so the weights
are fitted through the noisy-or, and the sentences' chances then say where the offence stands.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ampliframe.llm.common import map_rows, plain
from ampliframe.sources.stage import persist_stage

#: Bound of the training sample: so many labelled texts at most, chosen by a hash of their id.
MAX_TRAINING_DOCS = 8192
FOLDS = 5
#: Features of a word: itself and its first 3 to 8 letters. Those in at least ``MIN_DOCS`` training
#: texts that differ most between the classes are weighed.
PREFIXES = range(3, 9)
MIN_DOCS, MAX_FEATURES, MIN_CONTRAST = 4, 20_000, 2.0
EPOCHS, BATCH, RATE, PENALTY, START_BIAS = 30, 64, 0.5, 1e-4, -6.0
MAX_CACHED = 400_000

_sentences = re.compile(r"[^.!?\n]+(?:[.!?\n]+|$)").finditer
_words = re.compile(r"\w+").findall  # (text, from, to)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _sentences(text)]


def word_features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


class _WordWeights(dict):
    """Weight of each word met; emptied when full, frequent words come back from ``older``."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights, self.older = weights, {}

    def __missing__(self, word: str) -> float:
        known = self.older.get(word)
        if known is None:
            weights = self.weights
            known = weights.get("=" + word, 0.0)
            for k in PREFIXES:
                if len(word) <= k:
                    break
                known += weights.get("^" + word[:k], 0.0)
        if len(self) >= MAX_CACHED:
            self.older = dict(self)
            self.clear()
        self[word] = known
        return known


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self._words = weights, bias, _WordWeights(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def sentence_scores(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Each sentence's place in the text and its chance."""
        low, weight = text.lower(), self._words.__getitem__
        spans = sentence_spans(text)
        if len(low) == len(text):
            z = [sum(map(weight, _words(low, a, b))) for a, b in spans]
        else:  # lower-casing changed lengths
            z = [sum(map(weight, _words(text[a:b].lower()))) for a, b in spans]
        return spans, _sigmoid(self.bias + np.array(z, float))

    def score(self, text: str) -> float:
        return noisy_or(self.sentence_scores(text)[1])


def noisy_or(p: np.ndarray) -> float:
    """The chance that one sentence or more is toxic; 0 for a text without sentences."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def _codes(word: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f) for f in word_features(word)]


def _chosen_features(texts: list[str], y: np.ndarray) -> dict[str, int]:
    """The features that differ most between the classes, by texts that hold them. Features are
    counted as 64-bit codes in arrays, so that the counting stays small."""
    number: dict[str, int] = {}
    per_text = [np.array(sorted({number.setdefault(w, len(number)) for w in _words(t.lower())}), np.int64) for t in texts]
    codes = [np.array(_codes(w), np.uint64) for w in number]
    flat = np.concatenate([*codes, np.zeros(0, np.uint64)])
    known, flat = np.unique(flat, return_inverse=True)
    ends = np.cumsum([0, *map(len, codes)])
    held = np.zeros((2, len(known)))
    for words, label in zip(per_text, y.tolist()):
        if len(words):
            held[label, np.unique(np.concatenate([flat[ends[w]:ends[w + 1]] for w in words.tolist()]))] += 1
    totals = [max(int((y == k).sum()), 1) for k in (0, 1)]
    ratio = np.log((held[1] + 0.5) / (totals[1] + 1)) - np.log((held[0] + 0.5) / (totals[0] + 1))
    z = np.where(held.sum(axis=0) >= MIN_DOCS, np.abs(ratio) / np.sqrt(1 / (held[1] + 0.5) + 1 / (held[0] + 0.5)), 0)
    best = [i for i in np.argsort(-z, kind="stable")[:MAX_FEATURES].tolist() if z[i] >= MIN_CONTRAST]
    wanted = {int(known[i]): rank for rank, i in enumerate(best)}
    return {f: wanted[c] for w in number for f, c in zip(word_features(w), _codes(w)) if c in wanted}


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Adaptive gradient descent on the log loss of the noisy-or."""
    y = np.array(labels, int)
    place = _chosen_features(texts, y)
    known: dict[str, list[int]] = {}
    bags = []
    for text in texts:
        bag = []
        for a, b in sentence_spans(text):
            ids: set[int] = set()
            for word in _words(text[a:b].lower()):
                if word not in known:
                    known[word] = [place[f] for f in word_features(word) if f in place]
                ids.update(known[word])
            bag.append(sorted(ids))
        bags.append(bag)
    weights, bias = np.zeros(len(place)), START_BIAS
    seen, seen_bias = np.full(len(place), 1e-6), 1e-6
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        places = order.permutation(len(bags))
        for at in range(0, len(places), BATCH):
            chosen = places[at:at + BATCH]
            sentences = [s for i in chosen for s in bags[i]]
            per_text = np.array([len(bags[i]) for i in chosen])
            if not sentences:
                continue
            lengths = np.fromiter(map(len, sentences), np.int64, len(sentences))
            flat = np.fromiter(chain.from_iterable(sentences), np.int64, int(lengths.sum()))
            z = bias + _sums(weights[flat], lengths)
            p = _sigmoid(z)
            clean = np.exp(-np.minimum(_sums(np.logaddexp(0, z), per_text), 500))  # prod(1 - p_j)
            pull = np.where(y[chosen] > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)
            slope = p * np.repeat(pull, per_text)  # of the loss by each sentence's z
            step = np.bincount(flat, np.repeat(slope, lengths), len(place)) / len(chosen) + PENALTY * weights
            seen += step ** 2
            weights -= RATE * step / np.sqrt(seen)
            step_bias = slope.sum() / len(chosen)
            seen_bias += step_bias ** 2
            bias -= 0.1 * RATE * step_bias / np.sqrt(seen_bias)
    return Model({f: float(weights[i]) for f, i in place.items() if weights[i]}, float(bias))


def held_out(key):
    """The rows of one fold in five, by crc32 of the id as text; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "toxic", max_docs: int = MAX_TRAINING_DOCS) -> Model:
    """Fit on at most ``max_docs`` labelled texts outside the held-out fold.

    Rows without a label are ignored, a text labelled twice counts as toxic if one label says
    so. The chosen ids come from the labels alone; only their texts are read and sent to the
    driver, which holds the one bounded sample. Without labelled texts every score is low.
    """
    wanted = (labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
              .dropna().filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    wanted = persist_stage(wanted, "toxicity-sample")
    sample = (plain(docs, key, text).select("doc_id", "text")
              .join(F.broadcast(wanted), "doc_id")  # max_docs rows of two numbers
              .orderBy(F.xxhash64("doc_id", "text")).limit(max_docs).toPandas())
    return fit(sample["text"].tolist(), sample["y"].tolist())


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the worst sentence: its place among the sentences
    (``worst``), its text and its score. A map without shuffle; null and empty texts score 0 and
    have no worst sentence. The model
    holds at most ``MAX_FEATURES`` numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(rows):
        m, out = shared.value, []
        for doc, t in zip(rows["doc_id"], rows["text"]):
            spans, p = m.sentence_scores(t)
            if len(p):
                j = int(np.argmax(p))
                out.append((doc, noisy_or(p), j, t[slice(*spans[j])], float(p[j])))
            else:
                out.append((doc, 0.0, None, None, None))
        columns = list(zip(*out)) or [()] * 5
        return dict(zip(("doc_id", "score", "worst", "sentence", "sentence_score"), columns))

    found = map_rows(plain(docs, key, text).select("doc_id", "text"), work,
                     "doc_id long, score double, worst int, sentence string, sentence_score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst", "sentence", "sentence_score")
