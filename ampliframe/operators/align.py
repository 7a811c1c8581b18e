"""Distances to a centre, near neighbours, alignment to a centre, and masking of alignment columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ampliframe.functions import kmers, let
from ampliframe.functions.words import WORD_LETTERS, code_of, word_codes
from ampliframe.operators.partitioning import salted_join
from ampliframe.sources.stage import persist_stage

# Scores of the pairwise alignment (our choice), and score cells held at a time in one task.
MATCH, MISMATCH, GAP = 2, -1, -2
MAX_CELLS = 16_000_000


def kmer_distance(seqs: DataFrame, centre: str, k: int = 6) -> DataFrame:
    """1 - shared words / words of the shorter one, between every sequence and the centre."""
    spark = seqs.sparkSession
    words = (seqs.select("feature_id", F.explode(kmers(F.col("sequence"), k)).alias("kmer"))
             .groupBy("feature_id", "kmer").agg(F.count(F.lit(1)).alias("n")))
    of_centre = (spark.createDataFrame([(centre,)], "sequence string")
                 .select(F.explode(kmers(F.col("sequence"), k)).alias("kmer"))
                 .groupBy("kmer").agg(F.count(F.lit(1)).alias("m")))
    # The words of one sequence: never more rows than it has bases.
    shared = (words.join(F.broadcast(of_centre), "kmer", "left").groupBy("feature_id")
              .agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("shared"), F.sum("n").alias("words")))
    shorter = F.least("words", F.lit(len(centre) - k + 1))
    known = shared.select("feature_id", (1 - F.col("shared") / shorter).alias("distance"))
    # A sequence shorter than a word has no distance, but it is in the answer.
    return seqs.select("feature_id").join(known, "feature_id", "left")


def kmer_neighbours(seqs: DataFrame, min_similarity: float, k: int = 6) -> DataFrame:
    """``a, b, similarity``: pairs of sequences that share at least ``min_similarity`` of the words of the
    shorter one (words with their repeats); ``b`` is the longer one, of equally long ones the one with the
    larger id. ``feature_id`` is unique; sequences without a word of ACGT have no neighbours.

    Words are ordered rarest first. Of a sequence with ``n`` words, ``n - ceil(min_similarity n) + 1`` must
    hold one that any neighbour has too, so only these are joined with the words of sequences that are
    not shorter. Candidates are verified on their texts.
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity is above 0 and at most 1")
    words = (seqs.select("feature_id", F.explode(kmers(F.col("sequence"), k)).alias("_w"))
             .filter(F.col("_w").rlike(f"^[{WORD_LETTERS}]*$")).groupBy("feature_id", "_w").agg(F.count(F.lit(1)).alias("_n")))
    sizes = words.groupBy("feature_id").agg(F.sum("_n").alias("size"))
    tokens = words.join(sizes, "feature_id").select("feature_id", "size", code_of(F.col("_w")).alias("_w"),
                                                    F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_no"))
    tokens = persist_stage(tokens, "word-tokens")
    seen = tokens.groupBy("_w", "_no").agg(F.count(F.lit(1)).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("feature_id").orderBy("seen", "_w", "_no"))
    # A window holds the words of one sequence. A hair below the limit, so that rounding adds no demand.
    wanted = F.ceil(F.col("size") * F.lit(min_similarity) - 1e-9)
    prefix = salted_join(tokens, seen, ["_w", "_no"]).withColumn("_rank", rank).filter(
        F.col("_rank") <= F.col("size") - wanted + 1).select(F.col("feature_id").alias("a"), F.col("size").alias("_a"), "_w", "_no")
    longer = (F.col("size") > F.col("_a")) | ((F.col("size") == F.col("_a")) & (F.col("feature_id") > F.col("a")))
    pairs = salted_join(tokens, prefix, ["_w", "_no"]).filter(longer).select("a", F.col("feature_id").alias("b")).distinct()
    texts = seqs.select("feature_id", "sequence")
    both = pairs.join(texts.toDF("a", "seq_a"), "a").join(texts.toDF("b", "seq_b"), "b")
    return both.mapInArrow(_shared_words(k), "a string, b string, similarity double").filter(
        F.col("similarity") >= F.lit(min_similarity) - 1e-9)


def _shared_words(k: int):
    """Verifies a batch of pairs at once: words of both sides counted by pair and code."""
    def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, owner, _ = word_codes(texts, k)
        keys, n = np.unique(owner * 4 ** k + codes, return_counts=True)
        return keys, n, np.bincount(owner, minlength=len(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, n, size_x), (y, m, size_y) = (counts(batch[c].to_pylist()) for c in ("seq_a", "seq_b"))
            shared, at_x, at_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            both = np.bincount(shared // 4 ** k, np.minimum(n[at_x], m[at_y]), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(both / np.minimum(size_x, size_y))], ["a", "b", "similarity"])

    return run


def _codes(text: str, width: int) -> np.ndarray:
    row = np.zeros(width, dtype=np.uint8)
    row[:len(text)] = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    return row


DIAGONAL, UP, LEFT = range(3)


def _align_batch(texts: list[str], centre: str) -> dict[str, list]:
    """Global alignment of each text to the centre, one numpy row of scores for all at once.

    A gap in the centre costs the same at any place of a run, so the best run of insertions
    is a running maximum along the row. Of each cell only the move that led to it is kept, and all
    texts are stepped back together.
    """
    n, width = len(texts), max(map(len, texts))
    codes = np.stack([_codes(t, width) for t in texts])
    target = np.frombuffer(centre.encode("ascii"), dtype=np.uint8)
    rise = GAP * np.arange(width + 1, dtype=np.int32)
    above = np.broadcast_to(rise, (n, width + 1)).astype(np.int32)
    moves = np.full((len(target) + 1, n, width + 1), LEFT, np.uint8)
    for i, base in enumerate(target, 1):
        up = above + GAP
        diagonal = above[:, :-1] + np.where(codes == base, MATCH, MISMATCH)
        row = up.copy()
        row[:, 1:] = np.maximum(row[:, 1:], diagonal)
        row = np.maximum.accumulate(row - rise, axis=1) + rise
        moves[i][row == up] = UP
        moves[i][:, 1:][row[:, 1:] == diagonal] = DIAGONAL
        above = row
    i, j = np.full(n, len(target)), np.array([len(t) for t in texts])
    bases, inserted = np.full((n, len(target)), ord("-"), np.uint8), [np.zeros((3, 0), np.int64)]
    live = np.flatnonzero((i > 0) | (j > 0))
    while len(live):
        move = moves[i[live], live, j[live]]
        i[live] -= move != LEFT
        j[live] -= move != UP
        same, more = live[move == DIAGONAL], live[move == LEFT]
        bases[same, i[same]] = codes[same, j[same]]
        inserted.append(np.stack([more, i[more], codes[more, j[more]]]))
        live = live[(i[live] > 0) | (j[live] > 0)]
    # Steps ran backwards: turned round, the bases of an insertion stand in order.
    row, place, letter = np.concatenate(inserted, axis=1)[:, ::-1]
    order = np.lexsort((place, row))
    row, place, letters = row[order], place[order], letter[order].astype(np.uint8).tobytes().decode("ascii")
    cuts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])])) if len(row) else []
    inserts: list[list[dict]] = [[] for _ in texts]
    for at, end in zip(cuts, [*cuts[1:], len(row)]):
        inserts[row[at]].append({"place": int(place[at]), "text": letters[at:end]})
    return {"bases": [b.tobytes().decode("ascii") for b in bases], "inserts": inserts}


PAIRWISE = "bases string, inserts array<struct<place: int, text: string>>"


def align_to(seqs: DataFrame, centre: str) -> DataFrame:
    """Pairwise alignment of every sequence to the centre: the base (or ``-``) at each centre
    place, and the texts inserted before a place (or at the end)."""
    @F.pandas_udf(PAIRWISE)
    def pairwise(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, rows = list(part), {"bases": [], "inserts": []}
            step = max(1, MAX_CELLS // ((len(centre) + 1) * (max(map(len, texts), default=0) + 1)))
            for at in range(0, len(texts), step):
                for column, found in _align_batch(texts[at:at + step], centre).items():
                    rows[column] += found
            yield pd.DataFrame(rows, columns=["bases", "inserts"])

    return seqs.withColumn("pair", pairwise("sequence")).select(
        "feature_id", "sequence", F.col("pair.bases").alias("bases"), F.col("pair.inserts").alias("inserts"))


def choose_centre(seqs: DataFrame, ft: DataFrame | None = None) -> str:
    """The most abundant sequence, or without counts the longest; ties by id."""
    if ft is None:
        return seqs.orderBy(F.length("sequence").desc(), "feature_id").first()["sequence"]
    top = ft.groupBy("feature_id").agg(F.sum("frequency").alias("f"))
    return seqs.join(top, "feature_id").orderBy(F.col("f").desc(), "feature_id").first()["sequence"]


def star_align(seqs: DataFrame, centre: str) -> DataFrame:
    """Multiple alignment by one centre. Each gap before a centre place is as wide as the
    longest insert there, so all results have one length; removing ``-`` gives the input."""
    pairs = persist_stage(align_to(seqs, centre), "pairwise")
    longest = (pairs.select(F.inline("inserts")).groupBy("place")
               .agg(F.max(F.length("text")).alias("w")).orderBy("place").collect())
    # At most one gap per place of the centre: (place, width, bases up to the next gap).
    ends = [gap.place for gap in longest[1:]] + [len(centre)]
    gaps = F.array(*[F.struct(F.lit(gap.place).alias("place"), F.lit(gap.w).alias("w"), F.lit(end - gap.place).alias("run"))
                     for gap, end in zip(longest, ends)])
    if not longest:
        return pairs.select("feature_id", F.col("bases").alias("aligned"))

    def gap_and_run(gap: Column) -> Column:
        text = F.get(F.filter("inserts", lambda x: x["place"] == gap["place"]), F.lit(0))["text"]
        return F.concat(F.rpad(F.coalesce(text, F.lit("")), gap["w"], F.lit("-")),
                        F.substring(F.col("bases"), gap["place"] + 1, gap["run"]))

    return pairs.select("feature_id", F.concat(
        F.substring("bases", 1, longest[0].place), F.array_join(F.transform(gaps, gap_and_run), "")).alias("aligned"))


def column_counts(aln: DataFrame) -> DataFrame:
    return (aln.select(F.posexplode(F.split("aligned", "")).alias("pos", "base"))
            .groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n")))


def mask_alignment(aln: DataFrame, max_gap_frequency: float = 1.0,
                   min_conservation: float = 0.4) -> DataFrame:
    """Drops columns with too many gaps or without a base that is common enough.

    Frequencies are shares of all sequences. The list of kept columns is as long as the
    alignment is wide.
    """
    stats = column_counts(aln).groupBy("pos").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("base") == "-", F.col("n")).otherwise(F.lit(0))).alias("gaps"),
        F.coalesce(F.max(F.when(F.col("base") != "-", F.col("n"))), F.lit(0)).alias("top"))
    kept = sorted(r.pos for r in stats.filter(
        (F.col("gaps") / F.col("rows") <= max_gap_frequency)
        & (F.col("top") / F.col("rows") >= min_conservation)).select("pos").collect())
    places = F.array(*[F.lit(p) for p in kept]).cast("array<int>")
    return aln.select("feature_id", let(F.split("aligned", ""), lambda bases: F.array_join(
        F.transform(places, lambda p: F.get(bases, p)), "")).alias("aligned"))
