"""A corpus pipeline of five stages over ``documents``; each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampliframe.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from ampliframe.llm.common import table
from ampliframe.llm.queries import PATTERN, VOCABULARY
from ampliframe.session import configure
from ampliframe.sources.stage import persist_stage


#: Pieces that a task of the encoding remembers, fewer than the operator does by itself: the executors' memory still
#: holds what the steps before took.
CACHED = 120_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    configure(spark)
    return quality.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    configure(spark)
    return line_dedup.drop_shared_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    configure(spark)
    return ngram_join.drop_similar(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what is left."""
    configure(spark)
    return bpe.round_trip(docs, VOCABULARY, PATTERN, CACHED)


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("n-gram join", drop_near_copies),
          ("decontamination", decontaminated), ("encoding", encoded)]

#: Near copies, fingerprints and the encoding are beyond SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist_stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
