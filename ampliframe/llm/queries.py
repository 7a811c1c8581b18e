"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ampliframe.llm import (bpe, cross_tokens, decontaminate, html, line_dedup, ngram_join, packing, pitman_yor, quality, search, spans,
                            token_files, toxicity)
from ampliframe.llm.common import table

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
END_ID = 50256
BYTE_TOKENS, PIECE_TOKENS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and which."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_t")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op3_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract_pages(pages, html.fit(pages))


def op4_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written rows, their ids as a digest."""
    packed = packing.write_packed(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, END_ID)
    return packed.select("pack_id", "n_tokens", "doc_ids", "part_nos", "cu_seqlens", "position_resets",
                         "position_starts", F.sha2("ids", 256).alias("ids_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.span_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_sentences", "n_removed", "n_removed_words", "earlier_docs", F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, END_ID)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.align_tokenizers(table(spark, sf_dir, "documents"), BYTE_TOKENS, PIECE_TOKENS, PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_decontaminate, op2_bpe, op3_extract_html, op4_pack_tokens, op5_substring_dedup, op6_ngram_join,
    op7_token_counts, op8_toxicity, op9_line_dedup, op10_quality_rules, op11_lm_score, op12_ranked_search, op13_cross_tokens)}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL = {
    "op9_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), {_AZ}) AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, {_WORDS.format('text')} AS ws FROM d),
g AS (SELECT r, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') AS win
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM t) GROUP BY r),
l AS (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
dup AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, line, count(*) AS c FROM l
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
k AS (SELECT r, host, text, pos, lower(trim(line, {_SPACES})) AS key FROM l),
f AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT text) AS c FROM k WHERE key <> '' GROUP BY host, key) x
      JOIN (SELECT host, count(DISTINCT text) AS a FROM d GROUP BY host) y USING (host)
      WHERE c > {quality.MIN_DOCS} AND c > {quality.SHARE} * a),
rm AS (SELECT r, sum(length(key) - length(replace(key, ' ', '')) + 1) AS n FROM k JOIN f USING (host, key) GROUP BY r),
m AS (SELECT d.r, d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(rm.n, 0) AS n_removed
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN rm USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, n_removed::BIGINT AS n_removed,
       base_failed, NOT base_failed AND n_words - n_removed >= {quality.MIN_WORDS}
         AND n_words - n_removed >= {quality.MIN_LEFT} * n_words AS kept
FROM b""",
    "op12_ranked_search": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {_AZ}), '{{TERM}}') AS ws
           FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, len(ws) AS n FROM t WHERE len(ws) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, ws FROM (SELECT DISTINCT item_id, regexp_extract_all(translate(text, {_AZ}), '{{TERM}}') AS ws
      FROM benchmark WHERE text IS NOT NULL)),
a AS (SELECT DISTINCT q, unnest(ws) AS term FROM i),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM t) WHERE term IN (SELECT term FROM a) GROUP BY r, term),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
g AS (SELECT q, d.r, d.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM a JOIN p USING (term) JOIN w USING (term) JOIN d ON p.r = d.r CROSS JOIN s GROUP BY q, d.r, d.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM g WHERE score > 0)
JOIN i USING (q) WHERE rank <= 10""".replace("{TERM}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"),
}
