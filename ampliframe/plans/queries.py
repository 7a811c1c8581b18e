"""Registered queries: one per operator, each over the whole given tables.

A query is a function (spark, sf_dir) -> DataFrame; its SQL, where there is one, computes the
same rows in plain set operations.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ampliframe import functions as fn
from ampliframe.operators import align, classify, denoise as dn, errors, lookup, near, reads as rd
from ampliframe.operators import reshape, table as tb, taxa as tx
from ampliframe.operators.partitioning import number_rows
from ampliframe.plans import workflow as wf
from ampliframe.plans.inputs import READS, REFERENCES, TABLE, checking_sql, derive, load
from ampliframe.session import configure, new_path
from ampliframe.sources import sinks, text
from ampliframe.sources.stage import load_stage, persist_stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Inputs:
    """Lets a query write ``i.reads`` for the derived table of that name."""

    def __init__(self, spark: SparkSession, sf_dir: str, block: str):
        self.spark, self.sf_dir, self.block = spark, sf_dir, block

    def __getattr__(self, name: str) -> DataFrame:
        return derive(self.spark, self.sf_dir, self.block, name)


def query(block: str, sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Inputs(configure(spark), sf_dir, block))

        QUERIES[function.__name__] = run
        if sql is not None:
            SQL[function.__name__] = checking_sql(block, sql)
        return function
    return register


def r6(column: str) -> Column:
    return F.round(F.col(column), 6).alias(column)


# ------------------------------------------------------------------------------- reads

@query(READS, """
SELECT coalesce(f.sample_id, r.sample_id) AS sample_id, coalesce(f.lane, r.lane) AS lane,
       coalesce(f.read_no, r.read_no) AS read_no, coalesce(f.read_id, r.read_id) AS read_id,
       f.seq AS fwd, f.qual AS fwd_qual, r.seq AS rev, r.qual AS rev_qual,
       CASE WHEN r.seq IS NULL THEN 'missing_reverse' WHEN f.seq IS NULL THEN 'missing_forward'
            WHEN f.read_id <> r.read_id THEN 'id_mismatch' END AS pair_error
FROM (SELECT * FROM mates WHERE direction = 'F') f FULL JOIN (SELECT * FROM mates WHERE direction = 'R') r
  ON f.sample_id = r.sample_id AND f.lane = r.lane AND f.read_no = r.read_no""")
def pair_mates(i):
    return rd.pair_mates(i.mates)


@query(READS, """
SELECT sample_id, lane, direction, read_no, 'length_mismatch' AS error FROM mates WHERE length(seq) <> length(qual)
UNION ALL SELECT sample_id, lane, direction, read_no, 'bad_base' FROM mates
  WHERE NOT regexp_full_match(seq, '[ACGTN]*')
UNION ALL SELECT sample_id, lane, direction, NULL, 'duplicate_file' FROM mates
  GROUP BY sample_id, lane, direction HAVING count(DISTINCT file) > 1""")
def validate_reads(i):
    return rd.validate_reads(i.mates)


@query(READS, """
SELECT sample_id, read_no, substr(fwd, 1, length(regexp_extract(fwd_qual, '^[^!-5]*', 0))) AS fwd,
       substr(rev, 1, length(regexp_extract(rev_qual, '^[^!-5]*', 0))) AS rev FROM reads""")
def truncate_at_quality(i):
    return rd.truncate_at_quality(i.reads, trunc_q=20).select("sample_id", "read_no", "fwd", "rev")


@query(READS, """
SELECT sample_id, read_no, substr(fwd, 24, 127) AS fwd, substr(fwd_qual, 24, 127) AS fwd_qual,
       substr(rev, 21, 130) AS rev, substr(rev_qual, 21, 130) AS rev_qual
FROM reads_var WHERE length(fwd) >= 150 AND length(rev) >= 150""")
def trim_truncate(i):
    return rd.trim_truncate(i.reads_var, 23, 20, 150, 150)


@query(READS, """, ee AS (SELECT *,
  list_sum([pow(10, -(ascii(fwd_qual[j]) - 33) / 10.0) for j in range(1, length(fwd_qual) + 1)]) AS f,
  list_sum([pow(10, -(ascii(rev_qual[j]) - 33) / 10.0) for j in range(1, length(rev_qual) + 1)]) AS r FROM reads)
SELECT sample_id, read_no, fwd, rev FROM ee
WHERE f <= 0.15 AND r <= 0.15 AND NOT contains(fwd, 'N') AND NOT contains(rev, 'N')""")
def filter_expected_errors(i):
    return rd.filter_expected_errors(i.reads, 0.15, 0.15).select("sample_id", "read_no", "fwd", "rev")


@query(READS, """, cut AS (SELECT sample_id, read_no,
  substr(fwd, 1, length(regexp_extract(fwd_qual, '^[^!-5]*', 0))) AS fwd,
  substr(fwd_qual, 1, length(regexp_extract(fwd_qual, '^[^!-5]*', 0))) AS fq,
  substr(rev, 1, length(regexp_extract(rev_qual, '^[^!-5]*', 0))) AS rev,
  substr(rev_qual, 1, length(regexp_extract(rev_qual, '^[^!-5]*', 0))) AS rq FROM reads),
trimmed AS (SELECT sample_id, read_no, substr(fwd, 6, 15) AS fwd, substr(fq, 6, 15) AS fq,
  substr(rev, 5, 16) AS rev, substr(rq, 5, 16) AS rq FROM cut WHERE length(fwd) >= 20 AND length(rev) >= 20)
SELECT sample_id, read_no, fwd, rev FROM trimmed
WHERE list_sum([pow(10, -(ascii(fq[j]) - 33) / 10.0) for j in range(1, length(fq) + 1)]) <= 0.005
  AND list_sum([pow(10, -(ascii(rq[j]) - 33) / 10.0) for j in range(1, length(rq) + 1)]) <= 0.005""")
def filter_reads(i):
    return wf.filter_reads(i.reads, 5, 4, 20, 20, 20, 0.005).select("sample_id", "read_no", "fwd", "rev")


@query(READS, " SELECT sample_id, direction, count(*) AS reads FROM directed GROUP BY 1, 2")
def demux_counts(i):
    return rd.demux_counts(rd.by_direction(i.reads))


@query(READS, """, c AS (SELECT sample_id, direction, count(*) AS n FROM directed GROUP BY 1, 2)
SELECT direction, min(n) AS min_reads, quantile_cont(n, 0.5) AS median_reads, ROUND(avg(n), 6) AS mean_reads,
       max(n) AS max_reads, CAST(sum(n) AS BIGINT) AS total_reads FROM c GROUP BY 1""")
def demux_count_summary(i):
    return rd.demux_count_summary(i.directed).withColumn("mean_reads", F.round("mean_reads", 6))


SEVEN = ", ".join(f"ROUND(quantile_cont({{v}}, {f}), 6) AS {n}"
                  for f, n in zip(rd.SUMMARY_FRACTIONS, rd.SUMMARY_NAMES))


def seven_rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in rd.SUMMARY_NAMES})


@query(READS, f""", x AS (SELECT direction, j AS position, ascii(qual[j]) - 33 AS q FROM
  (SELECT direction, qual, unnest(range(1, length(qual) + 1)) AS j FROM directed_var) z)
SELECT direction, CAST(position AS INTEGER) AS position, count(*) AS n, {SEVEN.format(v='q')} FROM x GROUP BY 1, 2""")
def quality_by_position(i):
    return seven_rounded(rd.quality_by_position(i.directed_var))


@query(READS, f""" SELECT direction, count(*) AS n, {SEVEN.format(v='length(seq)')} FROM directed_var GROUP BY 1""")
def read_length_summary(i):
    return seven_rounded(rd.read_length_summary(i.directed_var))


@query(READS, """ SELECT sample_id, read_no, fwd FROM reads
ORDER BY md5(concat(sample_id, '|', read_no, '|', 7)), sample_id, read_no LIMIT 700""")
def sample_reads(i):
    return rd.sample_reads(i.reads, 700, 7, ["sample_id", "read_no"]).select("sample_id", "read_no", "fwd")


@query(READS, """, x AS (SELECT sample_id, direction, seq, j, sum(ascii(qual[j]) - 33) AS s, count(*) AS n FROM
  (SELECT *, unnest(range(1, length(qual) + 1)) AS j FROM directed) z GROUP BY ALL)
SELECT sample_id, direction, seq AS sequence, max(n) AS n,
       string_agg(CAST(CAST(ROUND(s / n * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY j) AS mean_quality
FROM x GROUP BY 1, 2, 3""")
def dereplicate(i):
    text_form = F.array_join(F.transform("mean_quality", lambda q: F.round(q * 100).cast("bigint").cast("string")), ",")
    return rd.dereplicate(rd.by_direction(i.reads)).withColumn("mean_quality", text_form)


@query(READS, """, bad AS (SELECT DISTINCT substr(sequence, j, 16) AS w FROM
  (SELECT sequence, unnest(range(1, length(sequence) - 14)) AS j FROM templates WHERE k IN (3, 11)) z),
words AS (SELECT DISTINCT sample_id, read_no, w FROM (
  SELECT sample_id, read_no, substr(fwd, j, 16) AS w FROM (SELECT *, unnest(range(1, length(fwd) - 14)) AS j FROM reads) a
  UNION ALL SELECT sample_id, read_no, substr(rev, j, 16) AS w FROM (SELECT *, unnest(range(1, length(rev) - 14)) AS j FROM reads) b) c),
hit AS (SELECT sample_id, read_no FROM words JOIN bad USING (w) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT sample_id, read_no, fwd, rev FROM reads ANTI JOIN hit USING (sample_id, read_no)""")
def remove_contaminants(i):
    genomes = i.templates.filter(F.col("k").isin(3, 11))
    return rd.remove_contaminants(i.reads, genomes, ["sample_id", "read_no"]).select(
        "sample_id", "read_no", "fwd", "rev")


# ----------------------------------------------------------------------------- denoising

@query(READS, """, c AS (SELECT DISTINCT sample_id, direction, origin AS centre FROM origins),
u AS (SELECT DISTINCT sample_id, direction, seq AS sequence FROM directed)
SELECT sample_id, direction, sequence, centre, CAST(hamming(sequence, centre) AS INTEGER) AS distance
FROM u JOIN c USING (sample_id, direction) WHERE hamming(sequence, centre) <= 3""")
def near_pairs(i):
    uniques = i.directed.select("sample_id", "direction", F.col("seq").alias("sequence")).distinct()
    centres = i.origins.select("sample_id", "direction", F.col("origin").alias("centre")).distinct()
    return near.near_pairs(uniques, centres, 3).select("sample_id", "direction", "sequence", "centre", "distance")


@query(READS, """, p AS (SELECT sample_id, fwd, reverse(translate(rev, 'ACGT', 'TGCA')) AS rc, count(*) AS n FROM reads GROUP BY 1, 2, 3),
o AS (SELECT *, list_max([x for x in range(12, 181) if right(fwd, x) = left(rc, x)]) AS overlap FROM p)
SELECT sample_id, concat(fwd, substr(rc, CAST(overlap AS INTEGER) + 1)) AS sequence, CAST(sum(n) AS BIGINT) AS n
FROM o WHERE overlap IS NOT NULL GROUP BY 1, 2""")
def merge_pairs(i):
    return dn.merge_pairs(dn.count_pairs(i.reads))


BIMERA_SQL = """, s AS (SELECT sample_id, sequence, n, length(sequence) AS len FROM asv),
rel AS (SELECT c.sample_id, c.sequence, p.sequence AS parent, c.len,
  len([x for x in range(1, least(c.len, p.len) + 1) if left(c.sequence, x) = left(p.sequence, x)]) AS lcp,
  len([x for x in range(1, least(c.len, p.len) + 1) if right(c.sequence, x) = right(p.sequence, x)]) AS lcs
  FROM s c JOIN s p ON c.sample_id = p.sample_id AND p.n > 1.0 * c.n AND p.sequence <> c.sequence),
hit AS (SELECT DISTINCT a.sample_id, a.sequence FROM rel a JOIN rel b
  ON a.sample_id = b.sample_id AND a.sequence = b.sequence AND a.parent <> b.parent AND a.lcp + b.lcs >= a.len),
flags AS (SELECT s.sample_id, s.sequence, s.n, hit.sequence IS NOT NULL AS bimera
  FROM s LEFT JOIN hit ON s.sample_id = hit.sample_id AND s.sequence = hit.sequence),
cons AS (SELECT sequence, CAST(sum(CAST(bimera AS BIGINT)) AS BIGINT) AS flagged, count(*) AS samples FROM flags GROUP BY 1
  HAVING sum(CAST(bimera AS BIGINT)) > 0 AND (sum(CAST(bimera AS BIGINT)) = count(*)
     OR sum(CAST(bimera AS BIGINT)) >= (count(*) - 1) * 0.9))"""


@query(READS, BIMERA_SQL + " SELECT sample_id, sequence, n, bimera FROM flags")
def flag_bimeras(i):
    return dn.flag_bimeras(i.asv)


@query(READS, BIMERA_SQL + " SELECT * FROM cons")
def consensus_bimeras(i):
    return dn.consensus_bimeras(dn.flag_bimeras(i.asv))


@query(READS, BIMERA_SQL + """ SELECT md5(sequence) AS feature_id, sample_id, CAST(sum(n) AS BIGINT) AS frequency
FROM asv ANTI JOIN cons USING (sequence) GROUP BY 1, 2""")
def chimera_free_table(i):
    asv = i.asv
    return dn.make_feature_table(dn.remove_bimeras(asv, dn.consensus_bimeras(dn.flag_bimeras(asv))))


@query(READS, " SELECT md5(sequence) AS feature_id, sample_id, CAST(sum(n) AS BIGINT) AS frequency FROM asv GROUP BY 1, 2")
def make_feature_table(i):
    return dn.make_feature_table(i.asv)


@query(READS, " SELECT DISTINCT md5(sequence) AS feature_id, sequence FROM asv")
def rep_seqs(i):
    return dn.rep_seqs(i.asv)


@query(READS, """, c AS (SELECT sample_id, count(*) AS i, count(*) FILTER (read_no % 5 > 0) AS f,
  count(*) FILTER (read_no % 7 > 0) AS d, count(*) FILTER (read_no % 3 = 0) AS m,
  count(*) FILTER (read_no % 6 = 0 AND sample_id <> 'S4') AS x FROM reads GROUP BY 1)
SELECT sample_id, i AS input, f AS filtered, d AS denoised, m AS merged, x AS non_chimeric,
  ROUND(100.0 * f / i, 6) AS pct_filtered, ROUND(100.0 * d / i, 6) AS pct_denoised,
  ROUND(100.0 * m / i, 6) AS pct_merged, ROUND(100.0 * x / i, 6) AS pct_non_chimeric FROM c""")
def denoise_stats(i):
    reads, no = i.reads, F.col("read_no")

    def counted(kept: Column) -> DataFrame:
        return reads.filter(kept).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))

    stats = dn.denoise_stats(
        input=counted(F.lit(True)), filtered=counted(no % 5 > 0), denoised=counted(no % 7 > 0),
        merged=counted(no % 3 == 0), non_chimeric=counted((no % 6 == 0) & (F.col("sample_id") != "S4")))
    return stats.select("sample_id", *dn.STEPS, *[r6(f"pct_{s}") for s in dn.STEPS[1:]])


TRANSITIONS = """, x AS (SELECT origin[j] AS from_base, seq[j] AS to_base, ascii(qual[j]) - 33 AS q FROM
  (SELECT origin, seq, qual, unnest(range(1, 181)) AS j FROM directed JOIN origins USING (read_no, direction)) z),
tc AS (SELECT from_base, to_base, CAST(q AS INTEGER) AS q, count(*) AS n FROM x GROUP BY 1, 2, 3)"""


def _with_true_centre(i) -> DataFrame:
    """Both mates are joined as one row: half as many rows move, and their equal parts lie side by side."""
    truth = i.r0.select(F.col("event_id").alias("read_no"), "fw", "rv")
    mates = F.array(*[F.struct(F.col(c).alias("centre"), F.col(m).alias("sequence"), F.col(f"{m}_qual").alias("quality"))
                      for c, m in (("fw", "fwd"), ("rv", "rev"))])
    return i.reads.select("read_no", "fwd", "fwd_qual", "rev", "rev_qual").join(truth, "read_no").select(F.inline(mates))


@query(READS, TRANSITIONS + " SELECT * FROM tc")
def transition_counts(i):
    return errors.transition_counts(_with_true_centre(i))


@query(READS, TRANSITIONS + """, b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b),
grid AS (SELECT f.b AS from_base, s.b AS to_base, CAST(q AS INTEGER) AS q FROM b f, b s, range(0, 46) r(q)),
sm AS (SELECT g.from_base, g.to_base, g.q, 1 + coalesce(sum(tc.n), 0) AS s FROM grid g LEFT JOIN tc
  ON g.from_base = tc.from_base AND g.to_base = tc.to_base AND tc.q BETWEEN g.q - 2 AND g.q + 2 GROUP BY 1, 2, 3)
SELECT from_base, to_base, q, ROUND(CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY from_base, q) AS DOUBLE), 6) AS rate FROM sm""")
def estimate_rates(i):
    return errors.estimate_rates(errors.transition_counts(_with_true_centre(i))).withColumn("rate", F.round("rate", 6))


@query(READS, TRANSITIONS + """, b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b),
grid AS (SELECT f.b AS from_base, s.b AS to_base, CAST(q AS INTEGER) AS q FROM b f, b s, range(0, 46) r(q)),
n AS (SELECT g.*, CAST(coalesce(tc.n, 0) AS DOUBLE) AS n, CAST(coalesce(sum(tc.n) OVER (PARTITION BY g.from_base, g.q), 0) AS DOUBLE) AS total
  FROM grid g LEFT JOIN tc ON g.from_base = tc.from_base AND g.to_base = tc.to_base AND g.q = tc.q),
fit AS (SELECT a.from_base, a.to_base, a.q, sum(b.total + 1) AS sw, sum((b.total + 1) * b.q) AS sx, sum((b.total + 1) * b.q * b.q) AS sxx,
  sum((b.total + 1) * log10((b.n + 1) / (b.total + 4))) AS sy, sum((b.total + 1) * b.q * log10((b.n + 1) / (b.total + 4))) AS sxy
  FROM n a JOIN n b ON a.from_base = b.from_base AND a.to_base = b.to_base AND b.q BETWEEN a.q - 2 AND a.q + 2 GROUP BY 1, 2, 3),
line AS (SELECT *, CASE WHEN from_base = to_base THEN 0 ELSE least(greatest(pow(10,
  (sy + (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * (sw * q - sx)) / sw), 1e-7), 0.25) END AS wrong FROM fit)
SELECT from_base, to_base, q, ROUND(CASE WHEN from_base = to_base THEN 1 - sum(wrong) OVER (PARTITION BY from_base, q) ELSE wrong END, 6) AS rate FROM line""")
def estimate_rates_linear(i):
    counts = errors.transition_counts(_with_true_centre(i))
    return errors.estimate_rates(counts, smoothing="linear").withColumn("rate", F.round("rate", 6))


def _uniques(i) -> DataFrame:
    return persist_stage(rd.rounded_quality(rd.dereplicate(rd.by_direction(i.reads))), "uniques")


# Candidates one by one in order of abundance: a centre unless an earlier centre explains it.
# The Poisson tail is summed with lgamma here.
# Unique reads with their mean qualities as text, of the reads in ``{directed}``.
UNIQUES_SQL = """, qs AS (SELECT sample_id, direction, seq, j, sum(ascii(qual[j]) - 33) AS s, count(*) AS n FROM
  (SELECT *, unnest(range(1, length(qual) + 1)) AS j FROM {directed}) z GROUP BY ALL),
u AS (SELECT sample_id, direction, seq AS sequence, max(n) AS n,
  string_agg(chr(CAST(floor(s / n + 0.5) AS INTEGER) + 33), '' ORDER BY j) AS quality FROM qs GROUP BY 1, 2, 3)"""

NOMINAL_RATE = """ln(CASE WHEN c.sequence[j] = u.sequence[j] THEN 1 - least(pow(10, -(ascii(u.quality[j]) - 33) / 10.0), 0.75)
      ELSE least(pow(10, -(ascii(u.quality[j]) - 33) / 10.0), 0.75) / 3 END)"""
# From a list of all rates in order of true base, read base and quality.
LISTED_RATE = """rt.r[((instr('ACGT', c.sequence[j]) - 1) * 4 + instr('ACGT', u.sequence[j]) - 1) * 46
      + least(ascii(u.quality[j]) - 33, 45) + 1]"""

# Candidates one by one in order of abundance: a centre unless an earlier centre explains it.
# The Poisson tail is summed with lgamma here. ``{x}`` tells several runs in one text apart.
RUN_SQL = """, big{x} AS (SELECT *, row_number() OVER (PARTITION BY sample_id, direction ORDER BY n DESC, sequence) AS r FROM u WHERE n >= 2),
size{x} AS (SELECT sample_id, direction, CAST(count(*) AS DOUBLE) AS in_group FROM u GROUP BY 1, 2),
near{x} AS (SELECT u.sample_id, u.direction, u.sequence, u.n, c.sequence AS centre, in_group, CAST(u.n AS DOUBLE) AS a,
    ln(c.n) + list_sum([{log_rate} for j in range(1, length(u.sequence) + 1)]) AS lm
  FROM u JOIN big{x} c ON u.sample_id = c.sample_id AND u.direction = c.direction AND length(u.sequence) = length(c.sequence)
    AND (c.n > u.n OR (c.n = u.n AND c.sequence < u.sequence))
  JOIN size{x} ON size{x}.sample_id = u.sample_id AND size{x}.direction = u.direction {rates} WHERE hamming(u.sequence, c.sequence) <= 6),
tail{x} AS (SELECT *, CASE WHEN n <= 1 OR a <= exp(lm) THEN 0 ELSE least(
    -exp(lm) + a * lm - lgamma(a + 1) + ln(list_sum([exp(x * lm - lgamma(a + x + 1) + lgamma(a + 1)) for x in range(0, 51)]))
    - CASE WHEN lm < ln(1e-8) THEN lm ELSE ln(1 - exp(-exp(lm))) END, 0) END AS chance FROM near{x}),
ok{x} AS (SELECT * FROM tail{x} WHERE chance + ln(in_group) >= ln(1e-40)),
cand{x} AS (SELECT b.sample_id, b.direction, b.sequence, b.r, coalesce(ex, []) AS ex FROM big{x} b LEFT JOIN
  (SELECT sample_id, direction, sequence, list(centre) AS ex FROM ok{x} GROUP BY 1, 2, 3) e
  ON e.sample_id = b.sample_id AND e.direction = b.direction AND e.sequence = b.sequence),
walk{x} AS (SELECT sample_id, direction, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS found FROM size{x}
  UNION ALL SELECT c.sample_id, c.direction, c.r,
    CASE WHEN list_has_any(found, c.ex) THEN found ELSE list_append(found, c.sequence) END
  FROM walk{x} JOIN cand{x} c ON c.sample_id = walk{x}.sample_id AND c.direction = walk{x}.direction AND c.r = walk{x}.r + 1),
centres{x} AS (SELECT sample_id, direction, unnest(found) AS centre FROM (SELECT * FROM walk{x}
  QUALIFY row_number() OVER (PARTITION BY sample_id, direction ORDER BY r DESC) = 1) w),
best{x} AS (SELECT ok.sample_id, ok.direction, ok.sequence, ok.centre FROM ok{x} ok
  SEMI JOIN centres{x} c ON c.sample_id = ok.sample_id AND c.direction = ok.direction AND c.centre = ok.centre
  ANTI JOIN centres{x} d ON d.sample_id = ok.sample_id AND d.direction = ok.direction AND d.centre = ok.sequence
  QUALIFY row_number() OVER (PARTITION BY ok.sample_id, ok.direction, ok.sequence ORDER BY ok.lm DESC, ok.centre) = 1),
found{x} AS (SELECT * FROM best{x} UNION ALL SELECT sample_id, direction, centre, centre FROM centres{x}),
assigned{x} AS (SELECT f.sample_id, f.direction, f.sequence, u.n, u.quality, f.centre FROM found{x} f
  JOIN u ON u.sample_id = f.sample_id AND u.direction = f.direction AND u.sequence = f.sequence)"""

# Smoothed rates of an assignment, as a list.
LEARN_SQL = """, tc{x} AS (SELECT centre[j] AS from_base, sequence[j] AS to_base, ascii(quality[j]) - 33 AS q, sum(n) AS n FROM
  (SELECT *, unnest(range(1, length(sequence) + 1)) AS j FROM assigned{x}) z GROUP BY 1, 2, 3),
b{x} AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b),
sm{x} AS (SELECT f.b AS from_base, s.b AS to_base, CAST(r.q AS INTEGER) AS q, 1 + coalesce(sum(tc.n), 0) AS s
  FROM b{x} f CROSS JOIN b{x} s CROSS JOIN range(0, 46) r(q) LEFT JOIN tc{x} tc
  ON f.b = tc.from_base AND s.b = tc.to_base AND tc.q BETWEEN r.q - 2 AND r.q + 2 GROUP BY 1, 2, 3),
rates{x} AS (SELECT from_base, to_base, q, CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY from_base, q) AS DOUBLE) AS rate FROM sm{x}),
list{x} AS (SELECT list(ln(rate) ORDER BY from_base, to_base, q) AS r FROM rates{x})"""

DENOISE_SQL = UNIQUES_SQL.format(directed="directed") + RUN_SQL.format(x="", log_rate=NOMINAL_RATE, rates="")


@query(READS, DENOISE_SQL + """ SELECT c.sample_id, c.direction, centre, n AS centre_n FROM centres c
JOIN big ON big.sample_id = c.sample_id AND big.direction = c.direction AND big.sequence = centre""")
def find_centres(i):
    return dn.find_centres(dn.prepare(_uniques(i)), errors.nominal_rates(i.spark))


@query(READS, DENOISE_SQL + " SELECT * FROM assigned")
def denoise(i):
    return dn.denoise(_uniques(i), errors.nominal_rates(i.spark))


@query(READS)
def learn_error_model(i):
    return dn.learn_error_model(_uniques(i))


@query(READS, UNIQUES_SQL.format(directed="directed") + RUN_SQL.format(x="", log_rate=NOMINAL_RATE, rates="") + LEARN_SQL.format(x="")
       + RUN_SQL.format(x="2", log_rate=LISTED_RATE, rates="CROSS JOIN list rt") + LEARN_SQL.format(x="2") + """
SELECT from_base, to_base, q, ROUND(rate, 6) AS rate FROM rates2""")
def learn_error_model_two_rounds(i):
    """Denoised with the nominal rates, learned, denoised with these, learned again. An assignment that
    stays the same learns the same rates."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # it may not be settled yet
        return dn.learn_error_model(_uniques(i), max_iter=2).select("from_base", "to_base", "q", r6("rate"))


TRIMMING = {"trim_f": 10, "trim_r": 5, "trunc_f": 170, "trunc_r": 175, "max_ee": 5.0}


def _workflow(i, rates: DataFrame | None = None) -> wf.Counts:
    return wf.reads_to_counts(i.reads.drop("k"), rates=rates, **TRIMMING)


@query(READS)
def reads_to_counts(i):
    return _workflow(i).table


@query(READS)
def reads_to_counts_stats(i):
    return _workflow(i).stats


# The whole way from reads to counts under the nominal rates.
FLOW_SQL = """, cut0 AS (SELECT sample_id, read_no,
  substr(fwd, 1, length(regexp_extract(fwd_qual, '^[^!-#]*', 0))) AS fwd, substr(fwd_qual, 1, length(regexp_extract(fwd_qual, '^[^!-#]*', 0))) AS fq,
  substr(rev, 1, length(regexp_extract(rev_qual, '^[^!-#]*', 0))) AS rev, substr(rev_qual, 1, length(regexp_extract(rev_qual, '^[^!-#]*', 0))) AS rq FROM reads),
trimmed AS (SELECT sample_id, read_no, substr(fwd, 11, 160) AS fwd, substr(fq, 11, 160) AS fq, substr(rev, 6, 170) AS rev, substr(rq, 6, 170) AS rq
  FROM cut0 WHERE length(fwd) >= 170 AND length(rev) >= 175),
kept AS (SELECT * FROM trimmed WHERE NOT contains(fwd, 'N') AND NOT contains(rev, 'N')
  AND list_sum([pow(10, -(ascii(fq[j]) - 33) / 10.0) for j in range(1, length(fq) + 1)]) <= 5
  AND list_sum([pow(10, -(ascii(rq[j]) - 33) / 10.0) for j in range(1, length(rq) + 1)]) <= 5),
kept_both AS (SELECT sample_id, 'F' AS direction, fwd AS seq, fq AS qual FROM kept UNION ALL SELECT sample_id, 'R', rev, rq FROM kept)""" \
    + UNIQUES_SQL.format(directed="kept_both") + RUN_SQL.format(x="", log_rate=NOMINAL_RATE, rates="") + """,
cp AS (SELECT k.sample_id, f.centre AS fwd, reverse(translate(r.centre, 'ACGT', 'TGCA')) AS rc, count(*) AS n FROM kept k
  JOIN assigned f ON f.direction = 'F' AND f.sample_id = k.sample_id AND f.sequence = k.fwd
  JOIN assigned r ON r.direction = 'R' AND r.sample_id = k.sample_id AND r.sequence = k.rev GROUP BY 1, 2, 3),
ov AS (SELECT *, list_max([x for x in range(12, 161) if right(fwd, x) = left(rc, x)]) AS overlap FROM cp),
asv_m AS (SELECT sample_id, concat(fwd, substr(rc, CAST(overlap AS INTEGER) + 1)) AS sequence, CAST(sum(n) AS BIGINT) AS n
  FROM ov WHERE overlap IS NOT NULL GROUP BY 1, 2)""" + BIMERA_SQL.replace("FROM asv)", "FROM asv_m)") + """,
clean AS (SELECT * FROM asv_m ANTI JOIN cons USING (sequence))"""


@query(READS, FLOW_SQL + " SELECT md5(sequence) AS feature_id, sample_id, CAST(sum(n) AS BIGINT) AS frequency FROM clean GROUP BY 1, 2")
def counts_with_given_rates(i):
    return _workflow(i, errors.nominal_rates(i.spark)).table


@query(READS, FLOW_SQL + """, st AS (SELECT sample_id, count(*) AS input FROM reads GROUP BY 1),
s1 AS (SELECT sample_id, count(*) AS n FROM kept GROUP BY 1), s2 AS (SELECT sample_id, CAST(sum(n) AS BIGINT) AS n FROM cp GROUP BY 1),
s3 AS (SELECT sample_id, CAST(sum(n) AS BIGINT) AS n FROM asv_m GROUP BY 1), s4 AS (SELECT sample_id, CAST(sum(n) AS BIGINT) AS n FROM clean GROUP BY 1)
SELECT st.sample_id, input, coalesce(s1.n, 0) AS filtered, coalesce(s2.n, 0) AS denoised, coalesce(s3.n, 0) AS merged, coalesce(s4.n, 0) AS non_chimeric,
  ROUND(100.0 * coalesce(s1.n, 0) / input, 6) AS pct_filtered, ROUND(100.0 * coalesce(s2.n, 0) / input, 6) AS pct_denoised,
  ROUND(100.0 * coalesce(s3.n, 0) / input, 6) AS pct_merged, ROUND(100.0 * coalesce(s4.n, 0) / input, 6) AS pct_non_chimeric
FROM st LEFT JOIN s1 USING (sample_id) LEFT JOIN s2 USING (sample_id) LEFT JOIN s3 USING (sample_id) LEFT JOIN s4 USING (sample_id)""")
def stats_with_given_rates(i):
    return _workflow(i, errors.nominal_rates(i.spark)).stats.select("sample_id", *dn.STEPS, *[r6(f"pct_{s}") for s in dn.STEPS[1:]])


# ------------------------------------------------------------------------------- taxonomy

@query(READS, """, c AS (SELECT taxon, substr(sequence, j, 7) AS kmer, count(*) AS n FROM
  (SELECT taxon, sequence, unnest(range(1, length(sequence) - 5)) AS j FROM ref_reads) z GROUP BY 1, 2),
tot AS (SELECT taxon, sum(n) AS total FROM c GROUP BY 1)
SELECT c.taxon, kmer, n, ROUND(ln((n + 0.001) / (total + 0.001 * 16384)), 6) AS log_p,
       ROUND(ln(0.001 / (total + 0.001 * 16384)), 6) AS log_absent FROM c JOIN tot ON c.taxon = tot.taxon""")
def train_taxonomy_nb(i):
    model = classify.train_taxonomy_nb(i.ref_reads.select("taxon", "sequence"))
    return classify.model_words(model).select("taxon", "kmer", "n", r6("log_p"), r6("log_absent"))


NB_ON = """, c AS (SELECT taxon, substr(sequence, j, 7) AS kmer, count(*) AS n FROM
  (SELECT taxon, sequence, unnest(range(1, length(sequence) - 5)) AS j FROM {refs}) z GROUP BY 1, 2),
tot AS (SELECT taxon, CAST(sum(n) AS DOUBLE) AS total FROM c GROUP BY 1),
fk AS (SELECT feature_id, substr(sequence, j, 7) AS kmer, count(*) AS m FROM
  (SELECT feature_id, sequence, unnest(range(1, length(sequence) - 5)) AS j FROM {features}) z GROUP BY 1, 2),
hits AS (SELECT feature_id, taxon, sum(m * (ln(n + 0.001) - ln(0.001))) AS gain FROM fk JOIN c USING (kmer) GROUP BY 1, 2),
sc AS (SELECT u.feature_id, tot.taxon, -ln((SELECT count(*) FROM tot))
    + (length(u.sequence) - 6) * (ln(0.001) - ln(total + 0.001 * 16384)) + coalesce(gain, 0) AS score
  FROM {features} u CROSS JOIN tot LEFT JOIN hits ON u.feature_id = hits.feature_id AND tot.taxon = hits.taxon),
ex AS (SELECT *, exp(score - max(score) OVER (PARTITION BY feature_id)) AS e FROM sc),
post AS (SELECT feature_id, taxon, score, e / sum(e) OVER (PARTITION BY feature_id) AS posterior FROM ex)"""
NB_SQL = NB_ON.format(features="unique_seqs", refs="ref_tax")


def _model(i) -> classify.TaxonomyModel:
    return classify.train_taxonomy_nb(i.ref_tax.select("taxon", "sequence"))


@query(READS, NB_SQL + """ SELECT feature_id, taxon, ROUND(posterior, 6) AS posterior FROM post JOIN hits USING (feature_id, taxon)""")
def posteriors(i):
    model = _model(i)
    return classify.posteriors(i.unique_seqs, model).join(model.taxa, "taxon_id").select(
        "feature_id", "taxon", r6("posterior"))


@query(READS, NB_SQL + """ SELECT feature_id, taxon, ROUND(posterior, 6) AS confidence
FROM post QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY ROUND(posterior, 9) DESC, taxon) = 1""")
def classify_nb(i):
    return classify.classify_nb(i.unique_seqs, _model(i)).select("feature_id", "taxon", r6("confidence"))


CUT_SQL = """, lv AS (SELECT feature_id, j AS level, array_to_string(list_slice(string_split(taxon, ';'), 1, j), ';') AS prefix, posterior
  FROM (SELECT *, unnest(range(1, len(string_split(taxon, ';')) + 1)) AS j FROM {post}) z),
sums AS (SELECT feature_id, level, prefix, sum(posterior) AS s FROM lv GROUP BY 1, 2, 3),
ok AS (SELECT * FROM sums WHERE s >= 0.7 QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY level DESC, s DESC, prefix DESC) = 1)
SELECT p.feature_id, coalesce(ok.prefix, 'Unassigned') AS taxon, ROUND(coalesce(ok.s, p.m), 6) AS confidence
FROM (SELECT feature_id, max(posterior) AS m FROM {post} GROUP BY 1) p LEFT JOIN ok ON p.feature_id = ok.feature_id"""


@query(READS, NB_SQL + CUT_SQL.format(post="post"))
def assign_taxonomy(i):
    return classify.assign_taxonomy(i.unique_seqs, _model(i)).select("feature_id", "taxon", r6("confidence"))


STRANDS_SQL = """, strands AS (SELECT concat('+', feature_id) AS feature_id, sequence FROM {seqs}
  UNION ALL SELECT concat('-', feature_id), reverse(translate(sequence, 'ACGT', 'TGCA')) FROM {seqs})"""


@query(READS, STRANDS_SQL.format(seqs="unique_seqs") + NB_ON.format(features="strands", refs="ref_tax") + """,
means AS (SELECT left(feature_id, 1) AS strand, avg(m) AS mean_confidence, count(*) AS n FROM
  (SELECT feature_id, max(posterior) AS m FROM post GROUP BY 1) z GROUP BY 1)
SELECT strand, ROUND(mean_confidence, 6) AS mean_confidence, n,
  mean_confidence = (SELECT max(mean_confidence) FROM means) AS chosen FROM means""")
def detect_orientation(i):
    return classify.detect_orientation(i.unique_seqs, _model(i)).withColumn(
        "mean_confidence", F.round("mean_confidence", 6))


# Many lineages, fragments on either strand. The log of the summed scores decides on the strand.
MIXED_SQL = STRANDS_SQL.format(seqs="fragments") + NB_ON.format(features="strands", refs="refs") + """,
proof AS (SELECT feature_id, max(score) + ln(sum(e)) AS evidence FROM ex GROUP BY 1),
side AS (SELECT a.feature_id[2:] AS feature_id, CASE WHEN a.evidence >= b.evidence THEN '+' ELSE '-' END AS strand
  FROM proof a JOIN proof b ON a.feature_id[1] = '+' AND b.feature_id = concat('-', a.feature_id[2:])),
mixed AS (SELECT side.feature_id, strand, taxon, posterior FROM side JOIN post ON post.feature_id = concat(strand, side.feature_id))"""


def _large_model(i) -> classify.TaxonomyModel:
    return classify.train_taxonomy_nb(i.refs)


@query(REFERENCES, MIXED_SQL + """ SELECT feature_id, strand, taxon, ROUND(posterior, 6) AS confidence
FROM mixed QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY ROUND(posterior, 9) DESC, taxon) = 1""")
def orient_seqs(i):
    return classify.orient_seqs(i.fragments, _large_model(i)).select("feature_id", "strand", "taxon", r6("confidence"))


@query(REFERENCES, MIXED_SQL + CUT_SQL.format(post="mixed"))
def assign_mixed_strands(i):
    return classify.assign_taxonomy(i.fragments, _large_model(i), orientation="auto").select("feature_id", "taxon", r6("confidence"))


@query(REFERENCES, NB_ON.format(features="fragments", refs="refs") + """ SELECT feature_id, taxon, ROUND(posterior, 6) AS confidence
FROM post QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY ROUND(posterior, 9) DESC, taxon) = 1""")
def classify_many_lineages(i):
    return classify.classify_nb(i.fragments, _large_model(i)).select("feature_id", "taxon", r6("confidence"))


CENTRE_SQL = "(SELECT sequence FROM unique_seqs ORDER BY n DESC, feature_id LIMIT 1)"


def _centre(i) -> str:
    counts = i.unique_seqs.select("feature_id", F.col("n").alias("frequency"))
    return align.choose_centre(i.unique_seqs, counts)


@query(READS, f""", ctr AS {CENTRE_SQL},
w AS (SELECT feature_id, substr(sequence, j, 6) AS kmer, count(*) AS n FROM
  (SELECT *, unnest(range(1, length(sequence) - 4)) AS j FROM unique_seqs) z GROUP BY 1, 2),
cw AS (SELECT substr(sequence, j, 6) AS kmer, count(*) AS m FROM
  (SELECT *, unnest(range(1, length(sequence) - 4)) AS j FROM ctr) z GROUP BY 1)
SELECT feature_id, ROUND(1 - CAST(sum(least(n, coalesce(m, 0))) AS DOUBLE) / least(sum(n), (SELECT sum(m) FROM cw)), 6) AS distance
FROM w LEFT JOIN cw USING (kmer) GROUP BY 1""")
def kmer_distance(i):
    return align.kmer_distance(i.unique_seqs, _centre(i)).select("feature_id", r6("distance"))


@query(READS, """, w AS (SELECT feature_id, substr(sequence, j, 6) AS kmer, count(*) AS n FROM
  (SELECT *, unnest(range(1, length(sequence) - 4)) AS j FROM indels) z GROUP BY 1, 2),
z AS (SELECT feature_id, CAST(sum(n) AS BIGINT) AS size FROM w GROUP BY 1),
p AS (SELECT x.feature_id AS f, y.feature_id AS g, sum(least(x.n, y.n)) AS shared FROM w x JOIN w y USING (kmer) GROUP BY 1, 2)
SELECT f AS a, g AS b, ROUND(CAST(shared AS DOUBLE) / s.size, 6) AS similarity FROM p JOIN z s ON s.feature_id = f JOIN z t ON t.feature_id = g
WHERE (t.size > s.size OR (t.size = s.size AND g > f)) AND shared >= 0.8 * s.size""")
def kmer_neighbours(i):
    return align.kmer_neighbours(i.indels, 0.8).select("a", "b", r6("similarity"))


@query(READS, " SELECT feature_id, sequence, 1 AS widths FROM indels")
def star_align(i):
    """Gaps removed, every aligned row must be its input; all rows have one width."""
    aligned = persist_stage(align.star_align(i.indels, _centre(i)), "aligned")
    widths = aligned.agg(F.count_distinct(F.length("aligned")).cast("int").alias("widths"))
    return aligned.select("feature_id", F.replace("aligned", F.lit("-"), F.lit("")).alias("sequence")).join(
        F.broadcast(widths))  # one row


@query(READS, " SELECT feature_id, sequence, CAST(matches AS INTEGER) AS matches, CAST(inserted AS INTEGER) AS inserted FROM family")
def star_align_planted(i):
    """Sequences of one template with three bases put in or taken out: places that agree with the
    template's aligned row, and bases in places where it has a gap."""
    family = i.family.select("feature_id", "sequence")
    template = i.r0.filter("k = 19").select("fw").first()
    centre = template["fw"] if template else ""
    aligned = persist_stage(align.star_align(family.unionByName(
        i.spark.createDataFrame([("template", centre)], "feature_id string, sequence string")), centre), "aligned")
    true = aligned.filter("feature_id = 'template'").select(F.col("aligned").alias("_true"))  # one row
    places = F.arrays_zip(F.split("aligned", "").alias("a"), F.split("_true", "").alias("t"))
    return aligned.filter("feature_id <> 'template'").join(F.broadcast(true)).select(
        "feature_id", F.replace("aligned", F.lit("-"), F.lit("")).alias("sequence"),
        F.size(F.filter(places, lambda p: (p["a"] == p["t"]) & (p["a"] != "-"))).alias("matches"),
        F.size(F.filter(places, lambda p: (p["t"] == "-") & (p["a"] != "-"))).alias("inserted"))


@query(READS, """, cc AS (SELECT j AS pos, aligned[j] AS base, count(*) AS n FROM
  (SELECT aligned, unnest(range(1, 181)) AS j FROM aln) z GROUP BY 1, 2),
st AS (SELECT pos, sum(n) AS rows_, sum(CASE WHEN base = '-' THEN n ELSE 0 END) AS gaps,
  max(CASE WHEN base <> '-' THEN n ELSE 0 END) AS top FROM cc GROUP BY 1),
kept AS (SELECT list(pos ORDER BY pos) AS ps FROM st WHERE gaps / rows_ <= 0.2 AND top / rows_ >= 0.4)
SELECT feature_id, array_to_string([aligned[p] for p in ps], '') AS aligned FROM aln, kept""")
def mask_alignment(i):
    return align.mask_alignment(i.aln, 0.2, 0.4)


# ------------------------------------------------------------------------- count summaries

@query(TABLE, """ SELECT count(DISTINCT sample_id) AS samples, count(DISTINCT feature_id) AS features,
CAST(sum(frequency) AS BIGINT) AS total_frequency FROM ft""")
def table_overview(i):
    return tb.table_overview(i.ft)


@query(TABLE, """ SELECT sample_id, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS features
FROM ft GROUP BY 1""")
def frequency_per_sample(i):
    return tb.frequency_per_sample(i.ft)


@query(TABLE, """ SELECT feature_id, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS samples
FROM ft GROUP BY 1""")
def frequency_per_feature(i):
    return tb.frequency_per_feature(i.ft)


@query(TABLE, """, f AS (SELECT feature_id, CAST(sum(frequency) AS BIGINT) AS v FROM ft GROUP BY 1)
SELECT min(v) AS minimum, quantile_cont(v, 0.25) AS first_quartile, quantile_cont(v, 0.5) AS median,
       quantile_cont(v, 0.75) AS third_quartile, max(v) AS maximum, ROUND(avg(v), 6) AS mean FROM f""")
def frequency_quantiles(i):
    return tb.frequency_quantiles(tb.frequency_per_feature(i.ft)).withColumn("mean", F.round("mean", 6))


@query(TABLE, """, s AS (SELECT sample_id, sum(frequency) AS f FROM ft GROUP BY 1)
SELECT CAST(d AS INTEGER) AS depth, area, count(*) FILTER (f >= d) AS samples_kept,
       CAST(coalesce(sum(d) FILTER (f >= d), 0) AS BIGINT) AS counts_kept
FROM s JOIN meta USING (sample_id), (SELECT unnest([1000, 13000, 15000, 16000, 1000000000]) AS d) dd GROUP BY 1, 2""")
def retention_at_depth(i):
    return tb.retention_at_depth(i.ft, [1000, 13000, 15000, 16000, 10**9], "area", i.meta)


@query(READS, f""", s AS (SELECT DISTINCT fwd AS sequence FROM reads_var)
SELECT count(*) AS n, CAST(min(length(sequence)) AS INTEGER) AS min_len, CAST(max(length(sequence)) AS INTEGER) AS max_len,
       ROUND(avg(length(sequence)), 6) AS mean_len, CAST(max(length(sequence)) - min(length(sequence)) AS INTEGER) AS range_len,
       ROUND(stddev_samp(length(sequence)), 6) AS std_len, {SEVEN.format(v='length(sequence)')} FROM s""")
def sequence_length_stats(i):
    stats = tb.sequence_length_stats(i.reads_var.select(F.col("fwd").alias("sequence")).distinct())
    return seven_rounded(stats).withColumns({c: F.round(c, 6) for c in ("mean_len", "std_len")})


@query(READS, " SELECT feature_id, CAST(length(sequence) AS INTEGER) AS len, sequence FROM unique_seqs ORDER BY 1")
def tabulate_seqs(i):
    return tb.tabulate_seqs(i.unique_seqs)


@query(TABLE, """ SELECT tax.feature_id, taxon, confidence, frequency, samples FROM tax JOIN
(SELECT feature_id, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS samples FROM ft GROUP BY 1) f
USING (feature_id) ORDER BY 1""")
def tabulate(i):
    return lookup.tabulate(i.tax, tb.frequency_per_feature(i.ft), key="feature_id")


@query(TABLE, " SELECT * FROM ft ORDER BY feature_id, sample_id LIMIT 6")
def head(i):
    return lookup.head(i.ft, ["feature_id", "sample_id"])


# ------------------------------------------------------------------- lineage filters, lookups

@query(TABLE, " SELECT * FROM pass1")
def filter_table_first_pass(i):
    return tx.filter_table_by_taxon(i.ft, i.tax, wf.INCLUDE, wf.EXCLUDE_FIRST)


@query(TABLE, " SELECT * FROM pass2")
def filter_table_both_passes(i):
    once = tx.filter_table_by_taxon(i.ft, i.tax, wf.INCLUDE, wf.EXCLUDE_FIRST)
    return tx.filter_table_by_taxon(once, i.tax, wf.INCLUDE, wf.EXCLUDE_SECOND, missing="drop")


@query(TABLE, """ SELECT ft.* FROM ft JOIN tax USING (feature_id)
WHERE lower(taxon) NOT IN ('unassigned', 'd_0__archaea;d_1__euryarchaeota')""")
def filter_table_exact(i):
    return tx.filter_table_by_taxon(i.ft, i.tax, exclude="Unassigned, D_0__Archaea;D_1__Euryarchaeota", mode="exact")


@query(TABLE, """ SELECT feature_id, p_name AS sequence FROM part JOIN tax ON CAST(p_partkey AS VARCHAR) = feature_id
WHERE contains(lower(taxon), 'd_') AND NOT (contains(lower(taxon), 'archaea') OR contains(lower(taxon), 'mitochondri')
  OR contains(lower(taxon), 'chloroplast') OR contains(lower(taxon), 'unassigned'))""")
def filter_seqs(i):
    seqs = load(i.spark, i.sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("feature_id"), F.col("p_name").alias("sequence"))
    return wf.remove_organelles(seqs, i.tax)


@query(TABLE, """ SELECT feature_id, p_name AS sequence FROM part JOIN tax ON CAST(p_partkey AS VARCHAR) = feature_id
WHERE contains(lower(taxon), 'd_') AND NOT (contains(lower(taxon), 'archaea') OR contains(lower(taxon), 'mitochondra')
  OR contains(lower(taxon), 'chloroplast') OR contains(lower(taxon), 'unassigned'))""")
def filter_seqs_first_pass(i):
    seqs = load(i.spark, i.sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("feature_id"), F.col("p_name").alias("sequence"))
    return tx.filter_seqs_by_taxon(seqs, i.tax, wf.INCLUDE, wf.EXCLUDE_FIRST)


@query(TABLE, " SELECT ft.* FROM ft WHERE feature_id NOT IN (SELECT feature_id FROM pass2)")
def removed_by_filter(i):
    return lookup.removed(i.ft, wf.remove_organelles(i.ft, i.tax, "drop").select("feature_id").distinct())


@query(TABLE, """, rare AS (SELECT ft.* FROM ft JOIN tax USING (feature_id) WHERE contains(lower(taxon), 'mitochondria') AND frequency >= 90)
SELECT DISTINCT sample_id FROM ft WHERE sample_id NOT IN (SELECT sample_id FROM rare)""")
def dropped_samples(i):
    """Few samples have so abundant a mitochondrion."""
    abundant = i.ft.filter(F.col("frequency") >= 90)
    return tx.dropped_samples(i.ft, tx.filter_table_by_taxon(abundant, i.tax, include="Mitochondria"))


@query(TABLE, """ SELECT sample_id, area, depth_m, site, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS features
FROM ft LEFT JOIN meta USING (sample_id) GROUP BY 1, 2, 3, 4""")
def attach_metadata(i):
    return lookup.attach_metadata(tb.frequency_per_sample(i.ft), i.meta)


@query(TABLE, """ SELECT o_orderkey, (SELECT arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey)
FROM lineitem WHERE l_orderkey = o_orderkey) AS part FROM orders""")
def match_lookup(i):
    orders, lines = load(i.spark, i.sf_dir, "orders"), load(i.spark, i.sf_dir, "lineitem")
    return lookup.match_lookup(orders.select("o_orderkey"), lines, "o_orderkey", "l_orderkey", "l_partkey",
                               ["l_linenumber", "l_partkey"], name="part")


@query(TABLE, " SELECT event_id, replace(props, '\"', '') AS props, event_type FROM events")
def strip_quotes(i):
    return lookup.strip_quotes(load(i.spark, i.sf_dir, "events").select("event_id", "props", "event_type"))


@query(TABLE, " SELECT sample_id, depth_m, depth_m / 1000 AS depth_km FROM meta")
def assign_column(i):
    with_km = lookup.assign_column(i.meta, "depth_km", F.col("depth_m") / 1000)
    return lookup.select_columns(with_km, ["sample_id", "depth_m", "depth_km"])


# ----------------------------------------------------------------------------- composition

def prefix_sql(level: str) -> str:
    """First ranks of ``taxon``, padded, in DuckDB."""
    return (f"array_to_string(list_slice(list_concat(string_split(taxon, ';'), "
            f"['__' for z in range(0, 5)]), 1, {level}), ';')")


@query(TABLE, f""" SELECT {prefix_sql('3')} AS taxon, sample_id, CAST(sum(frequency) AS BIGINT) AS frequency
FROM ft JOIN tax USING (feature_id) GROUP BY 1, 2""")
def collapse_taxa(i):
    return tx.collapse_taxa(i.ft, i.tax, 3)


@query(TABLE, f""" SELECT CAST(lv AS INTEGER) AS level, {prefix_sql('lv')} AS taxon, sample_id, CAST(sum(frequency) AS BIGINT) AS frequency
FROM ft JOIN tax USING (feature_id), range(1, 6) r(lv) GROUP BY 1, 2, 3""")
def collapse_all_levels(i):
    return tx.collapse_all_levels(i.ft, i.tax)


SHARES_SQL = f""", c AS (SELECT {prefix_sql('2')} AS taxon, sample_id, CAST(sum(frequency) AS BIGINT) AS frequency
FROM {{source}} JOIN tax USING (feature_id) GROUP BY 1, 2),
sh AS (SELECT *, CAST(frequency AS DOUBLE) / CAST(sum(frequency) OVER (PARTITION BY sample_id) AS DOUBLE) AS share FROM c)"""


@query(TABLE, SHARES_SQL.format(source="pass2") + " SELECT sample_id, taxon, frequency, ROUND(share, 6) AS share FROM sh")
def phylum_shares(i):
    """Share of each phylum in each sample after removing organelles and unassigned features."""
    return wf.composition(i.ft, i.tax, 2).select("sample_id", "taxon", "frequency", r6("share"))


@query(TABLE, """ SELECT feature_id, sample_id, frequency,
ROUND(CAST(frequency AS DOUBLE) / CAST(sum(frequency) OVER (PARTITION BY sample_id) AS DOUBLE), 6) AS share FROM ft""")
def relative_abundance(i):
    return tx.relative_abundance(i.ft).select("feature_id", "sample_id", "frequency", r6("share"))


@query(TABLE, SHARES_SQL.format(source="ft") + """, k AS (SELECT sample_id,
  coalesce(max(CASE WHEN taxon = 'D_0__Archaea;D_1__Euryarchaeota' THEN share END), 0) AS sort_value FROM sh GROUP BY 1)
SELECT sample_id, taxon, ROUND(share, 6) AS share, ROUND(sort_value, 6) AS sort_value,
  row_number() OVER (ORDER BY sort_value DESC, sample_id, taxon) - 1 AS place FROM sh JOIN k USING (sample_id)""")
def sort_samples_by_taxon(i):
    shares = tx.relative_abundance(tx.collapse_taxa(i.ft, i.tax, 2))
    ordered = tx.sort_samples(shares, taxon="D_0__Archaea;D_1__Euryarchaeota")
    return number_rows(ordered, "place").select("sample_id", "taxon", r6("share"), r6("sort_value"), "place")


@query(TABLE, SHARES_SQL.format(source="ft") + """ SELECT sample_id, taxon, ROUND(share, 6) AS share, depth_m AS sort_value,
  row_number() OVER (ORDER BY depth_m DESC, sample_id, taxon) - 1 AS place FROM sh JOIN meta USING (sample_id)""")
def sort_samples_by_metadata(i):
    shares = tx.relative_abundance(tx.collapse_taxa(i.ft, i.tax, 2))
    ordered = tx.sort_samples(shares, i.meta, "depth_m")
    return number_rows(ordered, "place").select("sample_id", "taxon", r6("share"), "sort_value", "place")


@query(TABLE, f""", c AS (SELECT {prefix_sql('3')} AS taxon, sample_id, sum(frequency) AS f FROM ft JOIN tax USING (feature_id) GROUP BY 1, 2),
top AS (SELECT taxon FROM c GROUP BY 1 ORDER BY sum(f) DESC, taxon LIMIT 8)
SELECT CASE WHEN taxon IN (SELECT taxon FROM top) THEN taxon ELSE 'other' END AS taxon, sample_id, CAST(sum(f) AS BIGINT) AS frequency
FROM c GROUP BY 1, 2""")
def top_taxa(i):
    return tx.top_taxa(tx.collapse_taxa(i.ft, i.tax, 3), 8)


@query(TABLE, SHARES_SQL.format(source="ft") + """ SELECT sample_id, taxon, frequency, ROUND(share, 6) AS share, site, area, depth_m
FROM sh LEFT JOIN meta USING (sample_id)""")
def barplot_table(i):
    return tx.barplot_table(i.ft, i.tax, i.meta, 2).withColumn("share", F.round("share", 6))


@query(TABLE, f""", c AS (SELECT CAST(lv AS INTEGER) AS level, {prefix_sql('lv')} AS taxon, sample_id, CAST(sum(frequency) AS BIGINT) AS frequency
FROM ft JOIN tax USING (feature_id), range(1, 6) r(lv) GROUP BY 1, 2, 3)
SELECT level, sample_id, taxon, frequency, ROUND(CAST(frequency AS DOUBLE) / CAST(sum(frequency) OVER (PARTITION BY level, sample_id) AS DOUBLE), 6) AS share,
  site, area, depth_m FROM c LEFT JOIN meta USING (sample_id)""")
def barplot_all_levels(i):
    return tx.barplot_all_levels(i.ft, i.tax, i.meta, 5).withColumn("share", F.round("share", 6))


KINGDOMS = ["D_0__Archaea", "D_0__Bacteria", "Unassigned"]


@query(TABLE, """, c AS (SELECT sample_id, string_split(taxon, ';')[1] AS taxon, sum(frequency) AS f FROM ft JOIN tax USING (feature_id) GROUP BY 1, 2),
s AS (SELECT sample_id, CAST(sum(f) AS DOUBLE) AS total,
  CAST(coalesce(sum(f) FILTER (taxon = 'D_0__Archaea'), 0) AS DOUBLE) AS a,
  CAST(coalesce(sum(f) FILTER (taxon = 'D_0__Bacteria'), 0) AS DOUBLE) AS b,
  CAST(coalesce(sum(f) FILTER (taxon = 'Unassigned'), 0) AS DOUBLE) AS u FROM c GROUP BY 1)
SELECT sample_id, ROUND(a / total, 6) AS "D_0__Archaea", ROUND(b / total, 6) AS "D_0__Bacteria",
       ROUND(u / total, 6) AS "Unassigned", site, area, depth_m FROM s LEFT JOIN meta USING (sample_id)""")
def barplot_wide(i):
    return tx.barplot_table(i.ft, i.tax, i.meta, 1, KINGDOMS).withColumns({t: F.round(t, 6) for t in KINGDOMS})


@query(TABLE, """ SELECT sample_id FROM meta WHERE sample_id NOT IN (SELECT sample_id FROM ft JOIN tax USING (feature_id)
WHERE contains(lower(taxon), 'mitochondria'))""")
def empty_samples(i):
    return tx.empty_samples(tx.filter_table_by_taxon(i.ft, i.tax, include="mitochondria"), i.meta)


# --------------------------------------------------------------------------------- reshape

AREAS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(TABLE, """, a AS (SELECT feature_id, area, sum(frequency) AS f FROM ft JOIN meta USING (sample_id) GROUP BY 1, 2)
SELECT feature_id, """ + ", ".join(
    f'CAST(coalesce(sum(f) FILTER (area = \'{a}\'), 0) AS BIGINT) AS "{a}"' for a in AREAS) + " FROM a GROUP BY 1")
def to_wide(i):
    pooled = i.ft.join(i.meta, "sample_id").groupBy("feature_id", F.col("area").alias("sample_id")).agg(
        F.sum("frequency").alias("frequency"))
    return reshape.to_wide(pooled, AREAS)


@query(TABLE, """ SELECT feature_id, area AS sample_id, CAST(sum(frequency) AS BIGINT) AS frequency
FROM ft JOIN meta USING (sample_id) GROUP BY 1, 2""")
def to_long(i):
    pooled = i.ft.join(i.meta, "sample_id").groupBy("feature_id", F.col("area").alias("sample_id")).agg(
        F.sum("frequency").alias("frequency"))
    return reshape.to_long(reshape.to_wide(pooled, AREAS))


# ------------------------------------------------------------------------ scalar functions

@query(READS, " SELECT read_no, reverse(translate(rev, 'ACGTN', 'TGCAN')) AS rc FROM reads")
def reverse_complement(i):
    return i.reads.select("read_no", fn.reverse_complement(F.col("rev")).alias("rc"))


@query(READS, """ SELECT read_no, direction, array_to_string([ascii(qual[j]) - 33 for j in range(1, length(qual) + 1)], ',') AS scores
FROM directed_var""")
def phred(i):
    scores = F.array_join(fn.phred(F.col("qual")).cast("array<string>"), ",")
    return i.directed_var.select("read_no", "direction", scores.alias("scores"))


@query(READS, " SELECT read_no, md5(fwd) AS feature_id FROM reads")
def feature_id(i):
    return i.reads.select("read_no", fn.feature_id(F.col("fwd")).alias("feature_id"))


@query(TABLE, """ SELECT feature_id, array_to_string([trim(x) for x in string_split(replace(taxon, ';', ' ; '), ';')], '|') AS lineage FROM tax""")
def split_taxonomy(i):
    spaced = F.replace(F.col("taxon"), F.lit(";"), F.lit(" ; "))
    return i.tax.select("feature_id", F.array_join(fn.split_taxonomy(spaced), "|").alias("lineage"))


@query(TABLE, r"""SELECT feature_id, label, CAST(nullif(regexp_extract(label, '^D_([0-9]+)__(.*)$', 1), '') AS INTEGER) AS level,
CASE WHEN regexp_matches(label, '^D_([0-9]+)__(.*)$') THEN regexp_extract(label, '^D_([0-9]+)__(.*)$', 2) END AS name
FROM (SELECT feature_id, unnest(string_split(taxon, ';')) AS label FROM tax) z""")
def rank_of(i):
    labels = i.tax.select("feature_id", F.explode(fn.split_taxonomy(F.col("taxon"))).alias("label"))
    rank = fn.rank_of(F.col("label"))
    return labels.select("feature_id", "label", rank["level"].alias("level"), rank["name"].alias("name"))


@query(READS, """ SELECT feature_id, substr(sequence, j, 7) AS kmer, count(*) AS n FROM
(SELECT *, unnest(range(1, length(sequence) - 5)) AS j FROM unique_seqs) z GROUP BY 1, 2""")
def kmers(i):
    words = i.unique_seqs.select("feature_id", F.explode(fn.kmers(F.col("sequence"), 7)).alias("kmer"))
    return words.groupBy("feature_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


@query(READS, " SELECT event_id, CAST(hamming(fw, fwd) AS INTEGER) AS distance FROM r0 JOIN reads ON event_id = read_no")
def hamming(i):
    both = i.r0.join(i.reads, F.col("event_id") == F.col("read_no"))
    return both.select("event_id", fn.hamming(F.col("fw"), F.col("fwd")).alias("distance"))


# ------------------------------------------------------------------------ sources and sinks

@query(TABLE, " SELECT sample_id, site, area, depth_m FROM meta")
def sample_metadata_round_trip(i):
    path = new_path(i.spark, "mapping")
    sinks.write_table(i.meta, path, ["sample_id"], na="", quote=False)
    return text.read_sample_metadata(i.spark, path).withColumn("sample_id", F.col("sample_id"))


@query(TABLE, " SELECT feature_id, taxon, confidence FROM tax")
def taxonomy_round_trip(i):
    path = new_path(i.spark, "taxonomy")
    sinks.export_taxonomy(i.tax, path)
    return text.read_taxonomy(i.spark, path, confidence_col="Confidence")


@query(TABLE, " SELECT feature_id, sample_id, CAST(frequency AS DOUBLE) AS frequency FROM ft")
def wide_text_round_trip(i):
    path = new_path(i.spark, "wide")
    sinks.write_biom_tsv(i.ft, path, compression="gzip")
    return reshape.to_long(text.read_biom_tsv(i.spark, path), row="#OTU ID").withColumnRenamed("#OTU ID", "feature_id")


@query(TABLE, " SELECT feature_id, sample_id, CAST(frequency AS DOUBLE) AS frequency FROM ft")
def wide_text_to_long(i):
    path = new_path(i.spark, "wide")
    sinks.write_biom_tsv(i.ft, path, i.tax, compression="gzip")
    return text.read_biom_long(i.spark, path)


@query(TABLE, " SELECT * FROM pass2")
def stage_round_trip(i):
    path = new_path(i.spark, "table")
    sinks.export_table(wf.remove_organelles(i.ft, i.tax), path)
    return load_stage(i.spark, path)


@query(TABLE, """ SELECT a.* RENAME (feature_id AS "#OTU ID"), CASE WHEN contains(taxon, 'Archaea') THEN NULL ELSE taxon END AS taxonomy
FROM (SELECT feature_id, """ + ", ".join(
    f'CAST(coalesce(sum(frequency) FILTER (area = \'{a}\'), 0) AS DOUBLE) AS "{a}"' for a in AREAS) + """
  FROM ft JOIN meta USING (sample_id) GROUP BY 1) a JOIN tax USING (feature_id)""")
def export_with_taxonomy(i):
    """Wide counts, lineage looked up (Archaea left out of the lookup: NA), text out and in."""
    pooled = i.ft.join(i.meta, "sample_id").groupBy("feature_id", F.col("area").alias("sample_id")).agg(
        F.sum("frequency").alias("frequency"))
    wide = reshape.to_wide(pooled, AREAS).withColumnRenamed("feature_id", "#OTU ID")
    known = i.tax.filter(~F.contains("taxon", F.lit("Archaea")))
    path = new_path(i.spark, "export")
    wf.export_with_taxonomy(wide, known, path)
    return text.read_biom_tsv(i.spark, path).withColumn("taxonomy", F.nullif("taxonomy", F.lit("NA")))


@query(TABLE, """, r AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS row_no FROM (SELECT DISTINCT feature_id FROM pass2) z),
c AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS col_no FROM (SELECT DISTINCT sample_id FROM pass2) z)
SELECT row_no, col_no, frequency AS value FROM pass2 JOIN r USING (feature_id) JOIN c USING (sample_id)""")
def biom_json_triples(i):
    return sinks.biom_json_parts(wf.remove_organelles(i.ft, i.tax))[2]


@query(TABLE, """ SELECT row_number() OVER (ORDER BY feature_id) - 1 AS row_no, feature_id, replace(taxon, ';', '|') AS taxonomy
FROM tax WHERE feature_id IN (SELECT feature_id FROM ft)""")
def biom_json_rows(i):
    return sinks.biom_json_parts(i.ft, i.tax)[0].withColumn("taxonomy", F.array_join("taxonomy", "|"))


@query(TABLE, """, r AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS row_no FROM (SELECT DISTINCT feature_id FROM ft) z),
c AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS col_no FROM (SELECT DISTINCT sample_id FROM ft) z),
lines AS (SELECT concat(CASE WHEN row_no = 0 THEN '' ELSE ',' END, '{"id":"', feature_id, '","metadata":{"taxonomy":["', replace(taxon, ';', '","'), '"]}}') AS line
  FROM r JOIN tax USING (feature_id)
UNION ALL SELECT concat(CASE WHEN col_no = 0 THEN '' ELSE ',' END, '{"id":"', sample_id, '","metadata":null}') FROM c
UNION ALL SELECT concat(CASE WHEN row_number() OVER (ORDER BY row_no, col_no) = 1 THEN '' ELSE ',' END, '[', row_no, ',', col_no, ',', frequency, ']')
  FROM ft JOIN r USING (feature_id) JOIN c USING (sample_id)
UNION ALL SELECT concat('{"id": null, "format": "Biological Observation Matrix 1.0.0", "format_url": "http://biom-format.org", "generated_by": "ampliframe", "date": "2020-05-14T00:00:00+00:00", "type": "OTU table", "matrix_type": "sparse", "matrix_element_type": "int", "shape": [',
  (SELECT count(*) FROM r), ', ', (SELECT count(*) FROM c), '], "rows": [')
UNION ALL SELECT '], "columns": [' UNION ALL SELECT '], "data": [' UNION ALL SELECT ']}')
SELECT line FROM lines""")
def biom_json_file(i):
    path = new_path(i.spark, "json")
    sinks.write_biom_json(i.ft, i.tax, path, date="2020-05-14T00:00:00+00:00")
    return i.spark.read.text(path).withColumnRenamed("value", "line")
