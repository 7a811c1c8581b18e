"""The pipeline against its stages by brute force, and the registered SQL."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from ampliframe.llm import queries

from .test_operators import SF, brute_components, brute_frequent, docs, texts, tokens, without_frequent  # noqa: F401


def comparable(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    theirs = duck.execute(queries.SQL[name])
    columns = [c[0] for c in theirs.description]
    ours = queries.QUERIES[name](spark, SF)
    assert sorted(ours.columns) == sorted(columns)
    assert comparable(ours.collect(), columns) == sorted(theirs.fetchall(), key=repr)


def test_pipeline_equals_brute_force(spark, docs, tokens):  # noqa: F811
    own, _ = tokens
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({queries.SQL['op10_quality_rules']}) WHERE kept").fetchall()}
    frequent = brute_frequent([(r.doc_id, r.text or "", r.source or "") for r in docs.collect()])
    left = {r.doc_id: without_frequent(r.text, r.source or "", frequent) for r in docs.collect() if r.doc_id in kept}
    holders = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for doc, text in left.items():
        for line in {key(x) for x in text.split("\n")}:
            if len(line) >= 20:
                holders.setdefault(line, set()).add(doc)
    left = {d: "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == d)
            for d, t in left.items()}
    first = {i for i, _, root in brute_components(left) if i == root}
    bad = {r.doc_id for r in queries.decontaminate.contaminated(
        spark.createDataFrame(sorted((i, left[i]) for i in first), "doc_id long, text string"),
        spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    wanted = {(i, len(own.encode_ordinary(left[i])), hashlib.sha256(left[i].encode()).hexdigest()) for i in first - bad}
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == wanted and 0 < len(got) < len(kept)


def test_stages_return_the_columns_of_documents(spark, docs):  # noqa: F811
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram join", "decontamination", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
