"""Column layouts of the tables that the operators pass to each other."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# One sequencing read per row, as it comes from a fastq file.
DIRECTED_READS = _struct(
    sample_id=T.StringType(), lane=T.IntegerType(), direction=T.StringType(),
    read_no=T.LongType(), read_id=T.StringType(), seq=T.StringType(),
    qual=T.StringType(), file=T.StringType(),
)

# One fragment per row, both mates side by side.
PAIRED_READS = _struct(
    sample_id=T.StringType(), lane=T.IntegerType(), read_no=T.LongType(),
    read_id=T.StringType(), fwd=T.StringType(), fwd_qual=T.StringType(),
    rev=T.StringType(), rev_qual=T.StringType(),
)
