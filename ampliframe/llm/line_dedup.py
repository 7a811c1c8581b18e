"""Line dedup: lines that many documents share stay only in the last of them. Native plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ampliframe.llm.common import LOWER, SPACES, UPPER, boxed, join_rows, plain, split_by, unboxed, wide_hash
from ampliframe.operators.partitioning import salted_join
from ampliframe.sources.stage import persist_stage

SALTS = 8


def _lines(text: Column | str = "text") -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, _t, pos, h1, h2`` of every line whose key is long enough to be judged."""
    return (docs.select("doc_id", "_t", F.posexplode(_lines()).alias("pos", "line"))
            .select("doc_id", "_t", "pos", line_key(F.col("line")).alias("key"))
            .filter(F.length("key") >= min_chars)
            .select("doc_id", "_t", "pos", *wide_hash("key")))


def shared_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """``h1, h2, last``: keys held by at least ``min_docs`` documents, and the largest holder.

    Documents per key are counted in two steps, first one row per (key, document), so a line
    that a third of all documents hold is spread by document and then pre-aggregated.
    """
    return (lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("_one"))
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_docs"), F.max("doc_id").alias("last"))
            .filter(F.col("_docs") >= min_docs).select("h1", "h2", "last"))


def _dropped(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``doc_id, _t, _drop``: the positions to drop, one row per document that loses lines."""
    lines = keyed_lines(docs, min_chars)
    hits = salted_join(lines, shared_keys(lines, min_docs), ["h1", "h2"], SALTS)
    return (hits.filter(~F.col("doc_id").eqNullSafe(F.col("last")))
            .groupBy("doc_id", "_t").agg(F.collect_set("pos").alias("_drop")))


def _judged(rows: DataFrame, text: Column, docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``rows`` with ``_n_lines``, ``_n_dropped`` and ``_kept``; rows that lose no line stay where they are."""
    drop = persist_stage(_dropped(docs, min_chars, min_docs), "dropped-lines")
    maybe, others = split_by(rows, drop)
    found = join_rows(maybe, drop, "left").withColumn("_lines", _lines(text))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.concat_ws("\n", F.transform(places, lambda i: F.col("_lines")[i]))
    changed = found.select(
        *rows.columns, F.size("_lines").cast("long").alias("_n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_dropped"),
        F.when(F.col("_drop").isNull(), text).otherwise(kept).alias("_kept"))
    return changed.unionAll(others.select(
        *rows.columns, F.size(_lines(text)).cast("long").alias("_n_lines"),
        F.lit(0).cast("long").alias("_n_dropped"), text.alias("_kept")))


def line_report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` (text), one row per input row.

    Lines are split at \\n. A key (:func:`line_key`) of at least ``min_chars`` code points held
    by at least ``min_docs`` different ids loses all its lines but those of the largest id. Only
    hashes meet in the counting and in the join, which is salted; texts that lose lines are shuffled
    once, to their dropped positions. Null or empty text: one empty line, kept. Repeated rows count as
    one document and lose the same lines. A null id counts as one document and is never the
    last. An empty table gives an empty table.
    """
    docs = plain(docs, key, text)
    return _judged(docs, F.col("text"), docs, min_chars, min_docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.col("_kept").alias("kept"))


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, key: str = "doc_id",
                      text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The input rows with the remaining text (see :func:`line_report`); ``n_chars``, where it
    is a column, follows the new text. Unchanged rows keep their null text."""
    old = F.col("_row").getField(text)
    rows = _judged(boxed(docs, key, text).drop("text"), F.coalesce(old, F.lit("")), plain(docs, key, text),
                   min_chars, min_docs)
    changed = {text: F.when(F.col("_n_dropped") == 0, old).otherwise(F.col("_kept"))}
    if n_chars in docs.columns:
        changed[n_chars] = F.when(F.col("_n_dropped") == 0, F.col("_row").getField(n_chars)).otherwise(
            F.length("_kept").cast(docs.schema[n_chars].dataType))
    return unboxed(rows, docs.columns, **changed)
