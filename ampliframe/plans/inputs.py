"""Amplicon-shaped inputs derived from the given tables.

One SQL text per block, run by Spark to make the inputs of the registered queries and by
DuckDB to make the inputs of the checking SQL. ``{events}`` and the like stand for tables.
Reads come from ``events`` (one fragment per event), counts from ``lineitem``, lineages from
``part``, sample metadata from ``supplier``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ampliframe.operators.partitioning import spread
from ampliframe.session import new_path
from ampliframe.sources.stage import persist_stage

READS = """
e AS (SELECT event_id, concat('S', cast(user_id % 12 AS string)) AS sample_id,
        cast(floor(sqrt(event_id % 400)) AS int) AS k FROM {events}),
t AS (SELECT k, translate(concat(
        md5(concat('t', cast(k AS string), '-0')), md5(concat('t', cast(k AS string), '-1')),
        md5(concat('t', cast(k AS string), '-2')), md5(concat('t', cast(k AS string), '-3')),
        md5(concat('t', cast(k AS string), '-4')), md5(concat('t', cast(k AS string), '-5')),
        md5(concat('t', cast(k AS string), '-6')), md5(concat('t', cast(k AS string), '-7'))),
        '0123456789abcdef', 'ACGTACGTACGTACGT') AS amp FROM (SELECT DISTINCT k FROM e) z),
r0 AS (SELECT event_id, sample_id, e.k AS k, substr(amp, 1, 180) AS fw,
        reverse(translate(substr(amp, 77, 180), 'ACGT', 'TGCA')) AS rv,
        substr(translate(concat(
        md5(concat('q', cast(event_id AS string), '-0')), md5(concat('q', cast(event_id AS string), '-1')),
        md5(concat('q', cast(event_id AS string), '-2')), md5(concat('q', cast(event_id AS string), '-3')),
        md5(concat('q', cast(event_id AS string), '-4')), md5(concat('q', cast(event_id AS string), '-5'))),
        '0123456789abcdef', '?@ABCDEFGHIIIII5'), 1, 180) AS qual
      FROM e JOIN t ON e.k = t.k),
reads AS (SELECT event_id AS read_no, sample_id, k,
        CASE WHEN event_id % 17 = 0 THEN concat(substr(fw, 1, cast(event_id % 150 AS int)),
             translate(substr(fw, cast(event_id % 150 AS int) + 1, 1), 'ACGT', 'CGTA'),
             substr(fw, cast(event_id % 150 AS int) + 2)) ELSE fw END AS fwd,
        qual AS fwd_qual, rv AS rev, qual AS rev_qual FROM r0),
reads_var AS (SELECT read_no, sample_id, substr(fwd, 1, cast(180 - read_no % 40 AS int)) AS fwd,
        substr(fwd_qual, 1, cast(180 - read_no % 40 AS int)) AS fwd_qual, rev, rev_qual FROM reads),
directed AS (SELECT sample_id, read_no, 'F' AS direction, fwd AS seq, fwd_qual AS qual FROM reads
        UNION ALL SELECT sample_id, read_no, 'R' AS direction, rev AS seq, rev_qual AS qual FROM reads),
directed_var AS (SELECT sample_id, read_no, 'F' AS direction, fwd AS seq, fwd_qual AS qual FROM reads_var
        UNION ALL SELECT sample_id, read_no, 'R' AS direction, rev AS seq, rev_qual AS qual FROM reads_var),
mates AS (SELECT sample_id, cast(1 AS int) AS lane, read_no, 'F' AS direction,
        concat('r', cast(read_no AS string)) AS read_id,
        CASE WHEN read_no % 53 = 0 THEN concat('X', substr(fwd, 2)) ELSE fwd END AS seq,
        CASE WHEN read_no % 59 = 0 THEN substr(fwd_qual, 1, 170) ELSE fwd_qual END AS qual,
        concat(sample_id, '_R1') AS file FROM reads WHERE read_no % 101 <> 0
        UNION ALL SELECT sample_id, cast(1 AS int) AS lane, read_no, 'R' AS direction,
        concat(CASE WHEN read_no % 89 = 0 THEN 'x' ELSE 'r' END, cast(read_no AS string)) AS read_id,
        rev AS seq, rev_qual AS qual,
        concat(sample_id, CASE WHEN read_no % 997 = 0 THEN '_R2b' ELSE '_R2' END) AS file
        FROM reads WHERE read_no % 103 <> 0),
templates AS (SELECT k, md5(amp) AS feature_id, amp AS sequence FROM t),
ref_tax AS (SELECT feature_id AS ref_id, k, sequence, concat('D_0__Bacteria;D_1__P', cast(k % 3 AS string),
        ';D_2__C', cast(k % 6 AS string), ';D_3__O', cast(k AS string)) AS taxon FROM templates),
mate_seqs AS (SELECT k, fwd AS sequence FROM reads UNION ALL SELECT k, rev AS sequence FROM reads),
unique_seqs AS (SELECT md5(sequence) AS feature_id, sequence, min(k) AS k, count(*) AS n
        FROM mate_seqs GROUP BY sequence),
origins AS (SELECT event_id AS read_no, sample_id, 'F' AS direction, fw AS origin FROM r0
        UNION ALL SELECT event_id AS read_no, sample_id, 'R' AS direction, rv AS origin FROM r0),
ref_reads AS (SELECT taxon, fwd AS sequence FROM reads JOIN ref_tax ON reads.k = ref_tax.k),
aln AS (SELECT feature_id, CASE WHEN k % 4 = 0
        THEN concat(substr(sequence, 1, 10), '-----', substr(sequence, 16))
        ELSE sequence END AS aligned FROM unique_seqs),
family AS (SELECT md5(s) AS feature_id, s AS sequence, min(matches) AS matches, min(inserted) AS inserted FROM (
        SELECT CASE WHEN event_id % 3 = 0 THEN concat(substr(fw, 1, cast(15 + event_id % 150 AS int)), 'ACG',
                                                     substr(fw, cast(16 + event_id % 150 AS int)))
                    WHEN event_id % 3 = 1 THEN concat(substr(fw, 1, cast(15 + event_id % 150 AS int)),
                                                     substr(fw, cast(19 + event_id % 150 AS int)))
                    ELSE fw END AS s,
               CASE WHEN event_id % 3 = 1 THEN 177 ELSE 180 END AS matches,
               CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END AS inserted FROM r0 WHERE k = 19) z GROUP BY s),
indels AS (SELECT DISTINCT md5(s) AS feature_id, s AS sequence FROM (
        SELECT CASE WHEN read_no % 5 = 0 THEN concat(substr(fwd, 1, 40), 'ACG', substr(fwd, 41))
                    WHEN read_no % 5 = 1 THEN concat(substr(fwd, 1, 60), substr(fwd, 64))
                    ELSE fwd END AS s FROM reads) z),
asv AS (SELECT sample_id, sequence, count(*) AS n FROM (
        SELECT sample_id, CASE
          WHEN event_id % 29 = 0 THEN concat(substr(a.amp, 1, cast(90 + event_id % 60 AS int)),
                                             substr(b.amp, cast(91 + event_id % 60 AS int)))
          WHEN event_id % 31 = 0 THEN concat(substr(a.amp, 1, 50), substr(a.amp, 56))
          ELSE a.amp END AS sequence
        FROM e JOIN t a ON e.k = a.k JOIN t b ON (e.k + 1) % 20 = b.k) z
        GROUP BY sample_id, sequence)
"""

TABLE = """
ft AS (SELECT cast(l_partkey AS string) AS feature_id, cast(l_suppkey AS string) AS sample_id,
        cast(sum(l_quantity) AS bigint) AS frequency FROM {lineitem} GROUP BY l_partkey, l_suppkey),
tax AS (SELECT cast(p_partkey AS string) AS feature_id, CASE
        WHEN p_partkey % 23 = 0 THEN 'Unassigned'
        WHEN p_partkey % 19 = 0 THEN 'D_0__Archaea;D_1__Euryarchaeota'
        WHEN p_partkey % 17 = 0 THEN 'D_0__Bacteria;D_1__Proteobacteria;D_2__Alphaproteobacteria;D_3__Rickettsiales;D_4__Mitochondria'
        WHEN p_partkey % 13 = 0 THEN 'D_0__Bacteria;D_1__Cyanobacteria;D_2__Oxyphotobacteria;D_3__Chloroplast'
        ELSE concat('D_0__Bacteria;D_1__', p_type, ';D_2__', p_brand, ';D_3__', replace(p_name, ' ', '_'))
        END AS taxon, cast(70 + p_partkey % 31 AS double) / 100 AS confidence FROM {part}),
meta AS (SELECT cast(s_suppkey AS string) AS sample_id, n_name AS site, r_name AS area, s_acctbal AS depth_m
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey),
pass1 AS (SELECT ft.* FROM ft JOIN tax ON ft.feature_id = tax.feature_id
        WHERE contains(lower(taxon), 'd_') AND NOT (contains(lower(taxon), 'archaea')
          OR contains(lower(taxon), 'mitochondra') OR contains(lower(taxon), 'chloroplast')
          OR contains(lower(taxon), 'unassigned'))),
pass2 AS (SELECT pass1.* FROM pass1 JOIN tax ON pass1.feature_id = tax.feature_id
        WHERE contains(lower(taxon), 'd_') AND NOT contains(lower(taxon), 'd_4__mitochondria'))
"""

# References and fragments that grow in number with the data: a reference per part, under a lineage of its
# own, and a fragment of one of them per customer, with a wrong base and for two in three the other strand.
REFERENCES = """
base AS (SELECT p_partkey AS id, translate(concat(
        md5(concat('r', cast(p_partkey AS string), '-0')), md5(concat('r', cast(p_partkey AS string), '-1')),
        md5(concat('r', cast(p_partkey AS string), '-2')), md5(concat('r', cast(p_partkey AS string), '-3')),
        md5(concat('r', cast(p_partkey AS string), '-4'))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence,
        concat('D_0__Bacteria;D_1__', p_type, ';D_2__', p_brand, ';D_3__', replace(p_name, ' ', '_'), ';D_6__',
               cast(p_partkey AS string)) AS taxon FROM {part}),
refs AS (SELECT taxon, sequence FROM base),
picked AS (SELECT c_custkey, 1 + (c_custkey * 7919) % top AS part_id FROM {customer}
        CROSS JOIN (SELECT max(p_partkey) AS top FROM {part}) z),
cut AS (SELECT c_custkey AS id, substr(sequence, cast(1 + c_custkey % 30 AS int), 130) AS s FROM picked
        JOIN base ON base.id = part_id),
marked AS (SELECT id, concat(substr(s, 1, cast(20 + id % 90 AS int)), translate(substr(s, cast(21 + id % 90 AS int), 1), 'ACGT', 'CGTA'),
        substr(s, cast(22 + id % 90 AS int))) AS s FROM cut),
fragments AS (SELECT cast(id AS string) AS feature_id, CASE WHEN id % 3 = 0 THEN s
        ELSE reverse(translate(s, 'ACGT', 'TGCA')) END AS sequence FROM marked)
"""

TABLES = {READS: ["events"], REFERENCES: ["part", "customer"], TABLE: ["lineitem", "part", "supplier", "nation", "region"]}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# What a run stores once and later steps read again: all read tables, and the counts.
STORED = {READS: None, REFERENCES: None, TABLE: {"ft"}}
# The table whose rows a block's inputs are made of, the columns it needs, and rows of one part.
SPREAD = {READS: ("events", ["event_id", "user_id"], 1 << 16), REFERENCES: ("customer", ["c_custkey"], 1 << 13),
          TABLE: ("lineitem", ["l_partkey", "l_suppkey", "l_quantity"], 1 << 18)}
# The templates are 20 rows, which Spark does not know: it would send all events to one task that holds the
# templates, or gather them under 20 keys. Hints for Spark; the checking SQL has none.
HINTS = [("r0 AS (SELECT ", "t"), ("ref_reads AS (SELECT ", "ref_tax"), ("n FROM (\n        SELECT ", "a, b")]
_plans: dict[tuple[str, str, str], DataFrame] = {}
_stored: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def derive(spark: SparkSession, sf_dir: str, block: str, name: str) -> DataFrame:
    """The named sub-query of a block over the tables of ``sf_dir``.

    Reads and counts are imported once per session and stored; queries then read the stored
    columns they need. Lineages and sample metadata stay plans over the given tables.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _stored:
        path, schema = _stored[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # the shared folder was emptied: import again
            del _stored[key]
    if key in _plans:
        return _plans[key]
    tables = {table: load(spark, sf_dir, table) for table in TABLES[block]}
    if block in SPREAD:
        # Little of a row is read and much is made of it, so the work goes by rows, not by the splits of a file.
        table, columns, n = SPREAD[block]
        tables[table] = spread(tables[table].select(*columns), n, columns[0])
    hinted = block
    if block == READS:
        for place, small in HINTS:
            hinted = hinted.replace(place, f"{place}/*+ BROADCAST({small}) */ ")
    rows = spark.sql(f"WITH {hinted} SELECT * FROM {name}", **tables)
    if STORED[block] is not None and name not in STORED[block]:
        _plans[key] = rows
        return rows
    path = new_path(spark, f"import-{name}")
    rows = persist_stage(rows, name, path)
    _stored[key] = (path, rows.schema)
    return rows


def checking_sql(block: str, rest: str) -> str:
    """The block with plain table names, then ``rest`` (further sub-queries or a SELECT)."""
    return f"WITH RECURSIVE {block.format(**{table: table for table in TABLES[block]}).strip()}{rest}"
