"""Reads: pairing, checks, trimming, quality filters, summaries, dereplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ampliframe.functions import expected_errors, kmers, quality_prefix_length
from ampliframe.functions.sequence import PHRED_OFFSET
from ampliframe.functions.words import MAX_WORD, WORD_LETTERS, code_of, word_codes
from ampliframe.operators.partitioning import salted_join, weighted_quantiles
from ampliframe.sources.stage import persist_stage

# The seven fractions of the summary tables.
SUMMARY_FRACTIONS = [0.02, 0.09, 0.25, 0.5, 0.75, 0.91, 0.98]
SUMMARY_NAMES = ["p02", "p09", "p25", "p50", "p75", "p91", "p98"]
FRAGMENT = ["sample_id", "lane", "read_no"]
# Positions whose qualities are summed in one row while dereplicating.
CHUNK = 16
# Contaminant words that go to every executor (64 MB), and fragments that are tested at a time.
MAX_WORDS, ROWS_AT_A_TIME = 1 << 23, 2048


def pair_mates(reads: DataFrame) -> DataFrame:
    """Both mates of a fragment on one row; ``pair_error`` is NULL where the pair is sound."""
    def side(direction: str, prefix: str) -> DataFrame:
        return reads.filter(F.col("direction") == direction).select(
            *FRAGMENT, F.col("read_id").alias(f"{prefix}_id"), F.col("seq").alias(prefix),
            F.col("qual").alias(f"{prefix}_qual"))

    pairs = side("F", "fwd").join(side("R", "rev"), FRAGMENT, "full_outer")
    error = (F.when(F.col("rev").isNull(), F.lit("missing_reverse"))
             .when(F.col("fwd").isNull(), F.lit("missing_forward"))
             .when(F.col("fwd_id") != F.col("rev_id"), F.lit("id_mismatch")))
    return pairs.select(*FRAGMENT, F.coalesce("fwd_id", "rev_id").alias("read_id"),
                        "fwd", "fwd_qual", "rev", "rev_qual", error.alias("pair_error"))


def validate_reads(reads: DataFrame) -> DataFrame:
    """One row per fault: unequal lengths, letters outside ACGTN, two files for one
    (sample, lane, direction). Empty when the input is sound."""
    files = ["sample_id", "lane", "direction"]
    faults = F.filter(F.array(
        F.when(F.length("seq") != F.length("qual"), F.lit("length_mismatch")),
        F.when(~F.col("seq").rlike("^[ACGTN]*$"), F.lit("bad_base"))), lambda f: f.isNotNull())
    per_read = (reads.withColumn("error", F.explode(faults))
                .select(*files, "read_no", "error"))
    per_file = (reads.select(*files, "file").distinct().groupBy(*files).count()
                .filter(F.col("count") > 1)
                .select(*files, F.lit(None).cast("bigint").alias("read_no"),
                        F.lit("duplicate_file").alias("error")))
    return per_read.unionByName(per_file)


def require_sound(pairs: DataFrame) -> DataFrame:
    """The pairs as they are; the job that reads them stops at the first one with a ``pair_error``,
    with a sequence and qualities of unequal lengths, or with letters outside ACGTN. No pass of its own.
    """
    faults = [F.col("pair_error")] if "pair_error" in pairs.columns else []
    for mate in ("fwd", "rev"):
        faults += [F.when(F.length(mate) != F.length(f"{mate}_qual"), F.lit(f"{mate}: length_mismatch")),
                   F.when(~F.col(mate).rlike("^[ACGTN]*$"), F.lit(f"{mate}: bad_base"))]
    fault = F.coalesce(*faults)
    stop = F.raise_error(F.concat_ws(" ", F.lit("unsound pair"), F.col("sample_id"), F.col("read_no"), fault))
    return pairs.filter(F.when(fault.isNull(), F.lit(True)).otherwise(stop.cast("boolean")))


def truncate_at_quality(pairs: DataFrame, trunc_q: int = 2) -> DataFrame:
    """Cut both mates before their first base with quality <= trunc_q."""
    cut = {}
    for mate in ("fwd", "rev"):
        kept = quality_prefix_length(F.col(f"{mate}_qual"), trunc_q)
        for column in (mate, f"{mate}_qual"):
            cut[column] = F.substring(F.col(column), F.lit(1), kept)
    return pairs.withColumns(cut)


def trim_truncate(pairs: DataFrame, trim_f: int = 23, trim_r: int = 20,
                  trunc_f: int = 200, trunc_r: int = 200) -> DataFrame:
    """Keep bases trim+1 … trunc; a pair with a mate shorter than trunc is dropped."""
    long_enough = (F.length("fwd") >= trunc_f) & (F.length("rev") >= trunc_r)
    cut = {column: F.substring(F.col(column), trim + 1, trunc - trim)
           for mate, trim, trunc in (("fwd", trim_f, trunc_f), ("rev", trim_r, trunc_r))
           for column in (mate, f"{mate}_qual")}
    return pairs.filter(long_enough).withColumns(cut)


def filter_expected_errors(pairs: DataFrame, max_ee_f: float = 2.0, max_ee_r: float = 2.0,
                           max_n: int = 0) -> DataFrame:
    """Keep pairs in which both mates have few expected errors and few N."""
    def n_count(seq: str) -> Column:
        return F.length(seq) - F.length(F.replace(F.col(seq), F.lit("N"), F.lit("")))

    return pairs.filter(
        (n_count("fwd") <= max_n) & (n_count("rev") <= max_n)
        & (expected_errors(F.col("fwd_qual")) <= max_ee_f)
        & (expected_errors(F.col("rev_qual")) <= max_ee_r))


def by_direction(pairs: DataFrame) -> DataFrame:
    """Paired rows as two rows, in one pass over the input."""
    mates = F.array(*[F.struct(F.lit(d).alias("direction"), F.col(m).alias("seq"),
                               F.col(f"{m}_qual").alias("qual"))
                      for d, m in (("F", "fwd"), ("R", "rev"))])
    others = [c for c in pairs.columns if c not in ("fwd", "fwd_qual", "rev", "rev_qual")]
    return pairs.select(*others, F.inline(mates))


def demux_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sample_id", "direction").agg(F.count(F.lit(1)).alias("reads"))


def demux_count_summary(reads: DataFrame) -> DataFrame:
    """Spread of the reads per sample, one row per direction."""
    counts = demux_counts(reads)
    sizes = counts.groupBy("direction", "reads").agg(F.count(F.lit(1)).alias("n"))
    median = weighted_quantiles(sizes, "reads", "n", {"median_reads": 0.5}, ["direction"])
    return counts.groupBy("direction").agg(
        F.min("reads").alias("min_reads"), F.avg("reads").alias("mean_reads"), F.max("reads").alias("max_reads"),
        F.sum("reads").alias("total_reads")).join(median, "direction").select(
        "direction", "min_reads", "median_reads", "mean_reads", "max_reads", "total_reads")


def _seven_numbers(counted: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quantiles of a value from its counts, so that only distinct values are shuffled."""
    quantiles = F.percentile(value, F.array(*[F.lit(f) for f in SUMMARY_FRACTIONS]), F.col("n"))
    return (counted.groupBy(*by).agg(F.sum("n").alias("n"), quantiles.alias("_q"))
            .select(*by, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(SUMMARY_NAMES)]))


def quality_by_position(reads: DataFrame, n: int | None = None, seed: int = 0,
                        key: list[str] | None = None) -> DataFrame:
    """Quality quantiles per direction and base position, over all reads or ``n`` sampled ones."""
    if n is not None:
        reads = sample_reads(reads, n, seed, key or ["sample_id", "direction", "read_no"])
    counted = (reads.select("direction", F.posexplode(F.split("qual", "")).alias("pos", "c"))
               .groupBy("direction", (F.col("pos") + 1).alias("position"),
                        (F.ascii("c") - PHRED_OFFSET).alias("q"))
               .agg(F.count(F.lit(1)).alias("n")))
    return _seven_numbers(counted, ["direction", "position"], "q")


def read_length_summary(reads: DataFrame) -> DataFrame:
    counted = reads.groupBy("direction", F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    return _seven_numbers(counted, ["direction"], "len")


def sample_reads(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by the md5 of the row key and the seed.

    The same rows come out on every run and for any partitioning. The cut-off is found from
    counts per hash prefix, so the chosen rows are never gathered in one task; only the few
    rows that share the last prefix are ordered.
    """
    keyed = df.withColumn("_h", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key],
                                                  F.lit(str(seed)))))
    below, left, prefix = F.lit(False), n, ""
    for width in (3, 6):
        starts = F.substring("_h", 1, width)
        inside = keyed.filter(F.col("_h").startswith(prefix)) if prefix else keyed
        buckets = sorted((r.b, r["count"]) for r in inside.groupBy(starts.alias("b")).count().collect())
        if not prefix and sum(c for _, c in buckets) <= n:
            return df
        for bucket, count in buckets:
            if count > left:
                below = below | (F.col("_h").startswith(prefix) & (starts < bucket))
                prefix = bucket
                break
            left -= count
    rest = keyed.filter(F.col("_h").startswith(prefix)).orderBy("_h", *key).limit(left)
    return keyed.filter(below).unionByName(rest).drop("_h")


def _summed_qualities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch one row for each of its (sample, direction, sequence): reads and sums of their scores by position."""
    for batch in batches:
        columns = [batch.column(i).dictionary_encode() for i in range(3)]
        key = np.zeros(batch.num_rows, np.int64)
        for c in columns:  # a null is a value of its own
            key = key * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))[:len(order)]
        first = order[starts]
        texts, qualities = batch.column(2).take(pa.array(first)).to_pylist(), batch.column(3).take(pa.array(order)).to_pylist()
        counts, sums = np.diff(np.append(starts, len(order))), []
        for text, at, n in zip(texts, starts.tolist(), counts.tolist()):
            size = len(text or "")
            lines = b"".join((q or "").encode().ljust(size, b"\0")[:size] for q in qualities[at:at + n])
            sums.append(np.frombuffer(lines, np.uint8).reshape(n, size).sum(axis=0, dtype=np.int64) - PHRED_OFFSET * n)
        same = batch.select([0, 1, 2]).take(pa.array(first))
        yield pa.RecordBatch.from_arrays([*same.columns, pa.array(counts), pa.array(sums, pa.list_(pa.int64()))],
                                         ["sample_id", "direction", "seq", "n", "sums"])


def dereplicate(reads: DataFrame) -> DataFrame:
    """Unique sequences per sample and direction: count and mean quality per position.

    Tasks sum the qualities of a batch first, on whole arrays. The sums then go on in chunks of 16 positions,
    one row per chunk, so map-side aggregation works on plain number columns and a hot sequence shrinks
    before the shuffle. A chunk carries 128 bits that stand for the whole sequence and its own 16
    bases; the sequence is put together again from these.
    """
    group = ["sample_id", "direction", "_a", "_b"]
    last = F.greatest(F.ceil(F.length("seq") / CHUNK).cast("int") - 1, F.lit(0))
    partly = reads.select("sample_id", "direction", "seq", "qual").mapInArrow(
        _summed_qualities, "sample_id string, direction string, seq string, n long, sums array<long>")
    chunks = partly.select(
        "sample_id", "direction", "seq", "n", "sums", F.xxhash64("seq").alias("_a"),
        F.xxhash64(F.lit(1), "seq").alias("_b"), F.explode(F.sequence(F.lit(0), last)).alias("_c")).select(
        *group, "_c", F.substring(F.col("seq"), F.col("_c") * CHUNK + 1, F.lit(CHUNK)).alias("_piece"), "n",
        *[F.coalesce(F.get("sums", F.col("_c") * CHUNK + j), F.lit(0)).alias(f"_s{j}") for j in range(CHUNK)])
    sums = [F.sum(f"_s{j}").alias(f"_s{j}") for j in range(CHUNK)]
    summed = chunks.groupBy(*group, "_c", "_piece").agg(F.sum("n").alias("n"), *sums)
    row = F.struct("_c", "_piece", F.array(*[f"_s{j}" for j in range(CHUNK)]).alias("s"))
    unique = summed.groupBy(*group).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(row)).alias("_rows"))
    unique = unique.withColumn("sequence", F.array_join("_rows._piece", ""))
    totals = F.slice(F.flatten(F.col("_rows.s")), F.lit(1), F.length("sequence"))
    return unique.select("sample_id", "direction", "sequence", "n",
                         F.transform(totals, lambda s: s / F.col("n")).alias("mean_quality"))


def rounded_quality(uniques: DataFrame) -> DataFrame:
    """Mean qualities as quality text (rounded), the form the error model uses."""
    text = F.array_join(F.transform(
        "mean_quality", lambda q: F.char(F.floor(q + 0.5).cast("int") + PHRED_OFFSET)), "")
    return uniques.select("sample_id", "direction", "sequence", "n", text.alias("quality"))


def remove_contaminants(pairs: DataFrame, contaminants: DataFrame, key: list[str],
                        k: int = 16, min_hits: int = 2, columns: tuple[str, ...] = ("fwd", "rev"),
                        max_words: int = MAX_WORDS) -> DataFrame:
    """Drop fragments that share at least ``min_hits`` different words of ACGT with a contaminant sequence.

    Words are packed, two bits a base. Up to ``max_words`` of them (8 bytes each) go to every executor
    as one sorted array, and fragments are tested where they are read, without a shuffle. More words
    are joined, salted; then only fragments with a shared word are moved.
    """
    if not 0 < k <= MAX_WORD:
        raise ValueError(f"words have 1 to {MAX_WORD} letters")
    bad = persist_stage(
        contaminants.select(F.explode(kmers(F.col("sequence"), k)).alias("_w"))
        .filter(F.col("_w").rlike(f"^[{WORD_LETTERS}]*$")).select(code_of(F.col("_w")).alias("_w")).distinct(), "bad-words")
    if bad.count() <= max_words:
        return _without_words(pairs, np.sort(bad.toArrow()["_w"].to_numpy()), k, min_hits, columns)
    own = pairs.select(*key, F.explode(F.concat(*[kmers(F.col(c), k) for c in columns])).alias("_w")).filter(
        F.col("_w").rlike(f"^[{WORD_LETTERS}]*$")).withColumn("_w", code_of(F.col("_w")))
    hit = (salted_join(own, bad, ["_w"]).distinct()
           .groupBy(*key).agg(F.count(F.lit(1)).alias("hits"))
           .filter(F.col("hits") >= min_hits).select(*key))
    # Stored, so that Spark knows how few they are before it plans the anti join.
    hit = persist_stage(hit, "contaminated")
    return pairs.join(hit, key, "left_anti")


def _without_words(pairs: DataFrame, bad: np.ndarray, k: int, min_hits: int, columns: tuple[str, ...]) -> DataFrame:
    """One map over the fragments, a bounded number of rows at a time."""
    shared, names = pairs.sparkSession.sparkContext.broadcast(bad), pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part, codes, owners = batch.slice(at, ROWS_AT_A_TIME), [], []
                for column in columns:
                    own, owner, _ = word_codes(part.column(names.index(column)).to_pylist(), k)
                    place = np.searchsorted(known, own)
                    hit = known[np.minimum(place, len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
                    codes.append(own[hit])
                    owners.append(owner[hit])
                # A word that a fragment has twice counts once.
                found = np.unique(np.stack([np.concatenate(owners), np.concatenate(codes)]), axis=1)[0]
                yield part.filter(pa.array(np.bincount(found, minlength=part.num_rows) < min_hits))

    return pairs.mapInArrow(run, pairs.schema)
