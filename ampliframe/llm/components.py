"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ampliframe.operators.partitioning import salted_join
from ampliframe.sources.stage import persist_stage

SALTS = 8


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer steps later: the links of one Arrow batch become stars around their smallest node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root: dict[int, int] = {}

            def top(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = root[x]
                return x

            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = top(u), top(v)
                root.setdefault(u, u), root.setdefault(v, v)
                root[max(u, v)] = min(u, v)
            stars = [(x, top(x)) for x in root if top(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root``: for each node of ``links`` (``a, b``) the smallest node it is linked with over
    any number of links. Nodes without a link to another have no row.

    Every round is stored, so a lost executor costs a re-read; the neighbours of a hub are spread
    by a salted join. Only a count and a sum come to the driver to see whether a round changed
    anything.
    """
    edges = persist_stage(_contracted(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.filter("v > u"), least, ["u"], SALTS).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = persist_stage(large.filter("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], SALTS)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges, before = persist_stage(small, "small-star"), state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
