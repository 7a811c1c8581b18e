"""Quality rules: measures of each text, its host's frequent lines removed, depleted texts rejected.

Documents of a host are told apart by their texts. Exact copies are one document here: counted by id, a
text copied a few thousand times would make all its own lines frequent, and every copy would be
rejected as depleted though it is clean (``count_copies`` does count them).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ampliframe.llm.common import SPACES, WORD, boxed, join_rows, map_rows, split_by, unboxed, wide_hash
from ampliframe.operators.partitioning import salted_join
from ampliframe.sources.stage import persist_stage

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: A line is frequent in a host if more than ``MIN_DOCS`` different texts and more than
#: ``SHARE`` of the host's different texts hold it.
MIN_DOCS = 10
SHARE = 0.01
#: A text is depleted if, without frequent lines, fewer than ``MIN_WORDS`` words or less than
#: this share of its words is left.
MIN_LEFT = 0.3

SALTS = 8
_words = re.compile(WORD).findall


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    rank, width = ids, 1
    while width < window:  # rank of windows twice as wide from two neighbours: exact, no hashing
        step = min(width, window - width)
        pair = rank[:len(rank) - step] * (len(ids) + 1) + rank[step:]
        if width + step == window:
            rank = pair
            break
        rank, width = np.unique(pair, return_inverse=True)[1], width + step
    order = np.sort(rank)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(rank, again))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measures(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text."""
    words = _words(text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif line and _words(line):
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words))


def base_rules(docs: DataFrame) -> DataFrame:
    """``doc_id, _t`` and the measures, ``base_failed``; a map without shuffle."""
    def work(rows):
        columns = list(zip(*map(measures, rows["text"]))) or [()] * 5
        return {"doc_id": rows["doc_id"], "_t": rows["_t"],
                **dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), columns))}

    found = map_rows(docs.select("doc_id", "_t", "text"), work, "doc_id long, _t long, n_words long, "
                     "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _normal_lines(docs: DataFrame) -> DataFrame:
    """``host, doc_id, _t, pos, h1, h2, words`` of every line with a word; normalised: no
    outer white space, lower case. Words are counted by spaces."""
    normal = F.lower(F.trim(F.col("line"), F.lit(SPACES)))
    return (docs.select("host", "doc_id", "_t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
            .select("host", "doc_id", "_t", "pos", normal.alias("key")).filter("key <> ''")
            .select("host", "doc_id", "_t", "pos", *wide_hash("key"),
                    (F.length("key") - F.length(F.replace("key", F.lit(" "))) + 1).alias("words")))


def frequent_lines(lines: DataFrame, docs: DataFrame, min_docs: int, share: float, count_copies: bool = False) -> DataFrame:
    """``host, h1, h2`` of the lines over the limits.

    Documents are counted by text, or with ``count_copies`` by text and id. One row per (host, line,
    document) first, then counts that are added up before the shuffle.
    """
    document = ["_t", "doc_id"] if count_copies else ["_t"]
    counts = (lines.groupBy("host", "h1", "h2", *document).agg(F.lit(1).alias("_one"))
              .groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("_docs"))
              .filter(F.col("_docs") > min_docs))
    hosts = (docs.groupBy("host", *document).agg(F.lit(1).alias("_one"))
             .groupBy("host").agg(F.count(F.lit(1)).alias("_all")))
    return (salted_join(counts, hosts, ["host"], SALTS)
            .filter(F.col("_docs") > share * F.col("_all")).select("host", "h1", "h2"))


def _by_host(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """``boxed`` with ``host``; ``_t`` also tells hosts apart, so that a text under two hosts is judged in each."""
    return (boxed(docs, key, text)
            .withColumn("host", F.coalesce(F.col("_row").getField(host).cast("string"), F.lit("")))
            .withColumn("_t", F.xxhash64("text", "host")))


def _judged(docs: DataFrame, min_docs: int, share: float, min_left: float, count_copies: bool) -> DataFrame:
    """Of ``docs(doc_id, _t, host, text)`` the measures, ``n_removed``, ``_drop`` (positions of frequent lines), ``kept``."""
    lines = _normal_lines(docs)
    frequent = persist_stage(frequent_lines(lines, docs, min_docs, share, count_copies), "frequent-lines")
    removed = (salted_join(lines, frequent, ["host", "h1", "h2"], SALTS)
               .groupBy("doc_id", "_t", "pos").agg(F.max("words").alias("words"))
               .groupBy("doc_id", "_t").agg(F.sum("words").alias("n_removed"), F.collect_list("pos").alias("_drop")))
    left = F.col("n_words") - F.col("n_removed")
    return (join_rows(base_rules(docs), removed, "left")
            .withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
            .withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words"))))


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                   min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT, count_copies: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, the measures, ``base_failed``, ``n_removed`` (words in
    frequent lines), ``kept``.

    A null text has no words and fails the base rules; rows without a host form a host of their
    own; a text under several hosts is judged in each; repeated rows get equal verdicts and count as one
    text. Hashes of lines, never lines, are shuffled; the join on frequent lines is salted, since one line
    may stand in a third of a host's texts. An empty table gives an empty table.
    """
    docs = _by_host(docs, key, text, host).select("doc_id", "_t", "host", "text")
    return _judged(docs, min_docs, share, min_left, count_copies).drop("_drop")


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", n_chars: str | None = "n_chars",
              min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT, count_copies: bool = False) -> DataFrame:
    """The input rows that :func:`quality_report` keeps, their texts without the host's frequent lines;
    ``n_chars``, where it is a column, follows the new text. Only ids and positions are joined, and only
    texts that may be rejected or lose lines are moved. Rows that lose no line are unchanged."""
    rows = _by_host(docs, key, text, host)
    report = _judged(rows.select("doc_id", "_t", "host", "text"), min_docs, share, min_left, count_copies)
    acted = persist_stage(report.filter(~F.col("kept") | F.col("_drop").isNotNull()).select("doc_id", "_t", "kept", "_drop")
                          .dropDuplicates(["doc_id", "_t"]), "acted-on")
    maybe, others = split_by(rows.select("_row", "doc_id", "_t"), acted)
    found = join_rows(maybe, acted, "left").filter(F.coalesce("kept", F.lit(True))).withColumn(
        "_lines", F.split(F.coalesce(F.col("_row").getField(text), F.lit("")), "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    left = F.concat_ws("\n", F.transform(places, lambda i: F.col("_lines")[i]))
    changed = {text: F.when(F.col("_drop").isNull(), F.col("_row").getField(text)).otherwise(left)}
    if n_chars in docs.columns:
        changed[n_chars] = F.when(F.col("_drop").isNull(), F.col("_row").getField(n_chars)).otherwise(
            F.length(left).cast(docs.schema[n_chars].dataType))
    return unboxed(found, docs.columns, **changed).unionAll(unboxed(others, docs.columns))
