"""N-gram Jaccard join: a grouped prefix join over word shingles, and its connected components.

A text's set is its distinct 4-word shingles. Two sets with Jaccard similarity of at least 85 %
share a shingle among the first ``n - ceil(0.85 n) + 1`` of each in any common order; rare
shingles first makes those prefixes selective. Texts with equal prefix and equal set size are
collapsed into one group, groups that share a prefix shingle and fit in size are paired, and the
pairs are expanded to different sets, filtered by parity signatures and verified on the texts.

Only connectivity is returned, so a list of texts that share a prefix shingle is not expanded
into all its pairs: in a long list texts are first compared with a hub near them, and once those
links are known, only texts of different components still need comparing.

A step's tables and shuffle files are deleted as soon as the next step has what it needs of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ampliframe.llm.common import _arrow_fields, boxed, join_rows, map_rows, plain, release, split_by, unboxed, without_rows
from ampliframe.llm.components import components
from ampliframe.llm.hashing import NOT_SPACE, distinct, run_codes, word_codes
from ampliframe.operators.partitioning import global_index, salted_join
from ampliframe.sources.stage import persist_stage, temporary_stages

#: Words in a shingle, similarity in percent.
SHINGLE, PERCENT = 4, 85
#: Shingle frequencies are counted in this many hash buckets, over all texts. The counts only order
#: the shingles, so sharing a bucket costs speed, never a link. They are 4 MB on every executor.
BUCKETS, SLICES = 1 << 20, 256
#: Lists of at most this many members are compared in full at once.
SMALL = 8
#: In longer lists each member is compared with the first of its run of so many, sorted by size.
RUN = 64
#: A shingle whose bucket counts more is spread over several tasks.
HOT = 4096
#: Bits of the parity signature of a set.
PARITY_BITS = 512
#: Members of a long list that are compared with one another or with as many others at a time.
BLOCK = 2048
#: Rows of one list that a task holds at a time.
MOST_HELD = 20_000
SALTS = 8

def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit codes of the 4-word shingles; of the whole sequence if it is shorter."""
    codes = word_codes(text, NOT_SPACE)
    return distinct(run_codes(codes, min(SHINGLE, max(len(codes), 1))))


def parities(codes: np.ndarray) -> bytes:
    """A bit per hash bucket, set if an odd number of shingles fall in it. What two sets share cancels
    out, so their bits differ in at most as many places as the sets differ in shingles."""
    return np.packbits(np.bincount((codes >> np.uint64(40)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1).tobytes()


def can_be_similar(apart: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles of which at least ``apart`` are in one only can reach
    the similarity: |difference| <= 15 / 185 of the sizes' sum, and the smaller at least 85 % of
    the larger."""
    return ((100 + PERCENT) * apart <= (100 - PERCENT) * (n + m)) & (
        100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= PERCENT * (len(a) + len(b) - same) and same > 0


# ------------------------------------------------------------------- frequencies, prefixes

def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many texts have a shingle in each bucket, over the whole table. A task adds up its texts
    and sends its counts in compressed slices; each slice is added up in one pass, a row at a time."""
    schema = "slice int, counts binary"
    fields = pa.schema(_arrow_fields(docs.sparkSession, schema))
    width = BUCKETS // SLICES

    def send(parts: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        rows = [(i, zlib.compress(c.astype("<i8").tobytes(), 1)) for i, c in parts]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                           pa.array([r[1] for r in rows], pa.binary())], schema=fields)

    def count(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts[(shingle_set(value.as_py()) % np.uint64(BUCKETS)).astype(np.int64)] += 1
        if counts.any():
            yield send((i, c) for i, c in enumerate(counts.reshape(SLICES, width)) if c.any())

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(c.as_py()), "<i8")
        if sums:
            yield send(sums.items())

    summed = (docs.select("text").mapInArrow(count, schema)
              .repartition(SLICES // 8, "slice").mapInArrow(add, schema))
    out = np.zeros((SLICES, width), np.int64)
    for row in summed.collect():  # SLICES rows of fixed size
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    return np.minimum(out.reshape(-1), 2 ** 31 - 1).astype(np.int32)


def _prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``doc_id, _t, n, s1, s2`` (hash of the set), ``p1, p2`` (hash of the prefix),
    ``prefix`` (its codes), ``parity``."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers

    def work(rows):
        frequency, out = shared.value, []
        for doc, t, text in zip(rows["doc_id"], rows["_t"], rows["text"]):
            codes = shingle_set(text)
            often = frequency[(codes % np.uint64(BUCKETS)).astype(np.int64)]
            # The codes are in order, and a stable sort keeps it within one frequency.
            first = codes[np.argsort(often, kind="stable")[:prefix_length(len(codes))]] if len(codes) else codes
            whole, start = xxhash.xxh3_128_digest(codes.tobytes()), xxhash.xxh3_128_digest(first.tobytes())
            out.append((doc, t, len(codes), *np.frombuffer(whole, "<i8").tolist(), *np.frombuffer(start, "<i8").tolist(),
                        first.view(np.int64).tobytes(), parities(codes)))
        return dict(zip(("doc_id", "_t", "n", "s1", "s2", "p1", "p2", "prefix", "parity"), list(zip(*out)) or [()] * 9))

    return map_rows(docs.select("doc_id", "_t", "text"), work, "doc_id long, _t long, n long, s1 long, s2 long, "
                    "p1 long, p2 long, prefix binary, parity binary")


def _tokens(groups: DataFrame, counts: np.ndarray) -> DataFrame:
    """``kind 0, key, salt, member, n``: the prefix shingles of each group (``gid, n, prefix``)."""
    shared = groups.sparkSession.sparkContext.broadcast(counts)
    schema = "kind int, key long, salt int, member long, n long"
    fields = pa.schema(_arrow_fields(groups.sparkSession, schema))

    def run(batches):
        frequency = shared.value
        for batch in batches:
            for gid, n, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                codes = np.frombuffer(prefix.as_py(), "<i8")
                often = frequency[(codes.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)]
                # 0: an ordinary shingle; from 1: the part of a frequent one's list.
                salt = np.where(often > HOT, 1 + (xxhash.xxh3_64_intdigest(str(gid)) >> 2) % (often.astype(np.int64) // HOT + 1), 0)
                size = len(codes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(size, np.int32)), pa.array(codes), pa.array(salt.astype(np.int32)),
                    pa.array(np.full(size, gid)), pa.array(np.full(size, n))], schema=fields)

    return groups.select("gid", "n", "prefix").mapInArrow(run, schema)


# ------------------------------------------------------------------------------ candidates

def _fits(n: int, m: int) -> bool:
    return 100 * min(n, m) >= PERCENT * max(n, m)


def _candidates(lists: DataFrame) -> DataFrame:
    """From ``kind, key, salt, member, n``: rows ``what, kind, key, a, b, n``. ``what`` 0: a pair to
    verify; 1: ``a`` is a member of a long list, whose other pairs remain to be seen to."""
    schema = "what int, kind int, key long, a long, b long, n long"
    fields = pa.schema(_arrow_fields(lists.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)
        hub: list | None = None  # of the long list that goes on: [member, n, members since]
        out: list[tuple] = []

        def long_list(rows: np.ndarray) -> None:
            nonlocal hub
            for kind, key, _, member, n in rows.T.tolist():
                out.append((1, kind, key, member, None, n))
                if hub and _fits(hub[1], n):
                    out.append((0, kind, key, min(hub[0], member), max(hub[0], member), n))
                if hub is None or hub[2] >= RUN:
                    hub = [member, n, 0]
                hub[2] += 1

        def whole_list(rows: np.ndarray) -> None:
            nonlocal hub
            if hub is None and rows.shape[1] <= SMALL and not rows[2, 0]:
                members = rows[3:].T.tolist()
                for i, (a, n) in enumerate(members):
                    for b, m in members[i + 1:]:
                        if _fits(n, m):
                            out.append((0, int(rows[0, 0]), int(rows[1, 0]), min(a, b), max(a, b), m))
            else:
                long_list(rows)
            hub = None

        def sent() -> Iterator[pa.RecordBatch]:
            if out:
                columns = list(zip(*out))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

        for batch in batches:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            held = np.concatenate([held, new], axis=1)
            if not held.shape[1]:
                continue
            edges = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [held.shape[1]]])
            last = int(starts[-1])
            for s, e in zip(starts[:-1].tolist(), ends[:-1].tolist()):
                # Lists of one member, by far the most, need nothing; parts of a list are not lists.
                if e - s > 1 or hub is not None or held[2, s]:
                    whole_list(held[:, s:e])
                if len(out) > 50_000:
                    yield from sent()
            held = held[:, last:]
            if held.shape[1] > MOST_HELD:  # keep one row so the end of the list is seen
                long_list(held[:, :-1])
                held = held[:, -1:]
            yield from sent()
        if held.shape[1] > 1 or hub is not None or held[2].any():
            whole_list(held)
        yield from sent()

    spread = lists.repartition("key", "salt").sortWithinPartitions("kind", "key", "salt", "n", "member")
    return spread.select("kind", "key", "salt", "member", "n").mapInArrow(run, schema)


@lru_cache(maxsize=512)
def _cached_set(text: str) -> np.ndarray:
    return shingle_set(text)


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64)


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose parities leave the similarity within reach; no similar pair is lost."""
    left, right = (classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
                   for c in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(
        "a", "b", "n_a", "n_b", "parity_a", "parity_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.bitwise_count(_bits(batch.column(4)) ^ _bits(batch.column(5))).sum(axis=1, dtype=np.int64)
            good = can_be_similar(apart, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar enough, stored. Few texts that stand in no pair are moved."""
    with temporary_stages(docs.sparkSession):
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        wanted = persist_stage(classes.select("rep", "rep_t").join(wanted.hint("merge"), "rep", "left_semi").select(
            F.col("rep").alias("doc_id"), F.col("rep_t").alias("_t")), "compared")
        texts = persist_stage(join_rows(split_by(docs.select("doc_id", "_t", "text"), wanted)[0], wanted, "left_semi")
                              .dropDuplicates(["doc_id", "_t"]).select("doc_id", "text"), "compared-texts")
        release(docs.sparkSession)
        left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = [similar(_cached_set(x.as_py()), _cached_set(y.as_py())) for x, y in zip(batch.column(2), batch.column(3))]
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], ["a", "b"])

        return persist_stage(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "similar", keep=True)


def _expanded(rows: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """Rows of kind 0 name a group in ``column``: put each of its sets' smallest ids there."""
    members = classes.select(F.col("gid").alias(column), F.col("rep").alias("_rep"))
    groups = rows.filter("kind = 0").join(members.hint("merge"), column).withColumn(column, F.col("_rep")).drop("_rep")
    return groups.unionByName(rows.filter("kind = 1"))


def _roots(docs: DataFrame, classes: DataFrame, groups: DataFrame, counts: np.ndarray) -> DataFrame:
    # Sets inside one group are a list of their own (kind 1), keyed by the group.
    several = classes.withColumn("_sets", F.count(F.lit(1)).over(_by("gid"))).filter("_sets > 1")
    inside = several.select(F.lit(1).alias("kind"), F.col("gid").alias("key"), F.lit(0).alias("salt"),
                            F.col("rep").alias("member"), "n")
    spark = docs.sparkSession
    with temporary_stages(spark):
        found = persist_stage(_candidates(_tokens(groups, counts).unionAll(inside)), "candidates")
        release(spark)
        # Long lists are unions of parts, so members are taken by key alone from here on.
        lists = persist_stage(_expanded(found.filter("what = 1").select("kind", "key", "a").distinct(), classes, "a")
                              .select("kind", "key", F.col("a").alias("rep")).distinct(), "long-lists", keep=True)
        pairs = found.filter("what = 0").select("kind", "a", "b").distinct()
        pairs = persist_stage(_expanded(_expanded(pairs, classes, "a"), classes, "b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "pairs")
        release(spark)
        possible = persist_stage(_possible(pairs, classes), "possible", keep=True)
    release(spark)
    links = _verified(possible, docs, classes)
    release(spark)
    # First one pair per pair of components that may be similar, which connects nearly all; then
    # every such pair that is left, so that a pair that failed hides no other.
    roots = components(links)
    for forest in (True, False):
        release(spark)
        rest = _remaining(lists, roots, classes, forest).join(possible.hint("merge"), ["a", "b"], "left_anti")
        rest = persist_stage(rest, "possible-rest")
        # The first may find only pairs that were tried; the second must still look behind them.
        if rest.limit(1).count():
            links = persist_stage(links.unionAll(_verified(rest, docs, classes)), "similar-rest")
            possible, roots = possible.unionAll(rest), components(links)
    return roots


def _by(column: str):
    from pyspark.sql import Window
    return Window.partitionBy(column)


def _remaining(lists: DataFrame, roots: DataFrame, classes: DataFrame, forest: bool) -> DataFrame:
    """Pairs ``a, b`` of members of one long list that are in different components and whose sizes and
    parities leave the similarity within reach.

    Lists inside one component fall away by an aggregate. The others are dealt out in cells of two
    blocks of bounded size, each pair of blocks to a task of its own, where parities are compared
    as arrays and only possible pairs are made. With ``forest`` a cell gives no pair that its
    earlier pairs connect already.
    """
    root = roots.select(F.col("node").alias("rep"), "root").hint("merge")
    placed = lists.join(root, "rep", "left").select("kind", "key", "rep", F.coalesce("root", "rep").alias("root"))
    open_lists = (placed.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("x"), F.max("root").alias("y"))
                  .filter("x <> y").select("kind", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    members = salted_join(placed, open_lists, ["kind", "key"], SALTS)
    members = members.join(classes.select("rep", "n", "parity").hint("merge"), "rep").withColumn(
        "own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "kind", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "root", "parity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cell(rows: pa.Table) -> pa.RecordBatch:
            side, reps, n, root = (rows.column(c).to_numpy() for c in ("own", "rep", "n", "root"))
            bits, one_block = _bits(rows.column("parity")), rows.column("i")[0] == rows.column("j")[0]
            up, out = {}, []

            def top(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            for x in range(len(reps) - 1):
                apart = np.bitwise_count(bits[x + 1:] ^ bits[x]).sum(axis=1, dtype=np.int64)
                good = can_be_similar(apart, n[x + 1:], n[x]) & (root[x + 1:] != root[x])
                if not one_block:
                    good &= side[x + 1:] != side[x]
                found = np.flatnonzero(good)
                for y in (found[np.argsort(apart[found], kind="stable")] + x + 1).tolist():
                    p, q = top(int(root[x])), top(int(root[y]))
                    if not forest or p != q:
                        out.append((min(int(reps[x]), int(reps[y])), max(int(reps[x]), int(reps[y]))))
                        up[max(p, q)] = min(p, q)
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], ["a", "b"])

        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            if not ids.shape[1]:
                continue
            edges = (np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()
            for start, end in zip([0, *edges], [*edges, ids.shape[1]]):
                part = batch.slice(start, end - start)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in range(4)):
                    yield cell(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield cell(pa.Table.from_batches(held))

    dealt = cells.repartition("kind", "key", "i", "j").sortWithinPartitions("kind", "key", "i", "j", "rep")
    return dealt.mapInArrow(run, "a long, b long").distinct()


# ---------------------------------------------------------------------------------- results

def _placed(docs: DataFrame) -> DataFrame:
    """``doc_id, _t, n_shingles, component_id``, one row per input row, stored."""
    spark = docs.sparkSession
    with temporary_stages(spark):
        release(spark)
        return persist_stage(_components_of(docs), "components", keep=True)


def _rows_of(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Of ``rows`` one for each of ``heads`` (``doc_id, _t``, each once and found among the rows). Nearly all rows are
    wanted, so the other keys, and those of repeated rows, are marked: a row that is certainly none of them stays
    where it lies."""
    keys = rows.groupBy("doc_id", "_t").agg(F.count(F.lit(1)).alias("_times"))
    others = persist_stage(join_rows(keys, heads, "left_anti").select("doc_id", "_t").unionAll(
        keys.filter("_times > 1").select("doc_id", "_t")).distinct(), "not-heads")
    maybe, sure = split_by(rows, others)
    return sure.unionAll(join_rows(maybe, heads, "left_semi").dropDuplicates(["doc_id", "_t"]))


def _components_of(docs: DataFrame) -> DataFrame:
    spark, counts = docs.sparkSession, bucket_counts(docs)
    rows = persist_stage(_prefixes(docs, counts), "prefixes")
    # One id per different set, one per group of equal prefix and size; null ids name nothing. Texts under one id
    # that differ but in words outside the rules share the set; take one. Copies are added up before they are moved.
    named = rows.filter("n > 0 and doc_id is not null")
    first = named.groupBy("n", "p1", "p2", "s1", "s2").agg(
        F.min(F.struct("doc_id", "_t")).alias("_first"), F.min("parity").alias("parity")).select(
        "n", "p1", "p2", "s1", "s2", F.col("_first.doc_id").alias("rep"), "parity", F.col("_first._t").alias("rep_t"))
    with temporary_stages(spark):
        first = persist_stage(first, "sets")
        release(spark)
        group = first.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"))
        classes = persist_stage(first.join(group, ["n", "p1", "p2"]), "groups", keep=True)
    release(spark)
    heads = classes.filter("rep = gid").groupBy("gid", "n", "p1", "p2").agg(F.min("rep_t").alias("_t")).select(F.col("gid").alias("doc_id"), "_t")
    prefix = _rows_of(rows.select("doc_id", "_t", "n", "prefix"), heads).select(F.col("doc_id").alias("gid"), "n", "prefix")
    roots = _roots(docs, classes, prefix, counts)
    placed = classes.join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select(
        "n", "s1", "s2", F.coalesce("root", "rep").alias("component"))
    slim = rows.select("doc_id", "_t", "n", "s1", "s2")
    release(spark)
    return salted_join(slim, placed, ["n", "s1", "s2"], SALTS, "left").select(
        "doc_id", "_t", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per input row.

    ``component_id`` is the smallest id that a text is linked with over any number of links of at
    least 85 % similarity, itself included. Null, empty and wordless texts have no shingles and are
    linked with nothing. Copies and repeated rows are one set. Texts under one id are judged
    apart, but links lead through the id. A null id names no component: such a row shows the
    component of its text's set, null if no row with an id has it.
    """
    return _placed(plain(docs, key, text)).select("doc_id", "n_shingles", "component_id")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a number of its own as the id of each text, in the order of ids (null last), and
    ``doc_id, _t, number``."""
    numbers = persist_stage(global_index(
        docs.select(F.col("doc_id").isNull().alias("_null"), "doc_id", "_t").distinct(), ["_null", "doc_id", "_t"], "number")
        .select("doc_id", "_t", "number"), "numbers")
    return join_rows(docs, numbers, "inner").select(F.col("number").alias("doc_id"), "text", "_t"), numbers


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows that stay if one document of each component is kept, the one with the smallest
    id; of a fully repeated row one. Texts without words stay. Different texts under one id, or
    without an id, are documents of their own, linked by their texts alone; null ids come last.
    Only ids are joined to the texts."""
    rows = plain(docs, key, text)
    with temporary_stages(docs.sparkSession):
        shared = rows.groupBy("doc_id").agg(F.min("_t").alias("x"), F.max("_t").alias("y")).filter("doc_id is null or x <> y")
        numbers = None
        if shared.limit(1).count():
            rows, numbers = _numbered(rows)
        placed = _placed(rows)
        gone = placed.filter("doc_id <> component_id").select("doc_id", "_t").distinct()
        repeated = placed.groupBy("doc_id", "_t").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id", "_t")
        if numbers is not None:
            gone, repeated = (x.select(F.col("doc_id").alias("number")).join(numbers.hint("merge"), "number").select("doc_id", "_t")
                              for x in (gone, repeated))
        gone, repeated = persist_stage(gone, "near-copies", keep=True), persist_stage(repeated, "repeated", keep=True)
    release(docs.sparkSession)
    kept = without_rows(boxed(docs, key, text), gone)
    if repeated.limit(1).count():
        some, others = split_by(kept, repeated)
        kept = others.unionAll(some.dropDuplicates(["doc_id", "_t"]))
    return unboxed(kept, docs.columns)
