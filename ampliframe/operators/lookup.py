"""Joins and column work on finished tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def one_row_per(df: DataFrame, key: str, what: str) -> DataFrame:
    """The table with equal rows of a key joined into one. Reading a key with different rows
    stops the job: a lookup in it would multiply rows."""
    others = [c for c in df.columns if c != key]
    box = F.struct(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)]) if others else F.lit(None)
    boxed = df.select(df[f"`{key}`"].alias("_k"), box.alias("_row"))
    grouped = boxed.groupBy("_k").agg(F.min("_row").alias("_row"), F.max("_row").alias("_other"))
    stop = F.raise_error(F.concat(F.lit(f"{what}: different rows for "), F.coalesce(F.col("_k").cast("string"), F.lit("NULL"))))
    same = grouped.filter(F.when(F.col("_row").eqNullSafe(F.col("_other")), F.lit(True)).otherwise(stop.cast("boolean")))
    return same.select(*[F.col("_k").alias(c) if c == key else F.col(f"_row.c{others.index(c)}").alias(c) for c in df.columns])


def missing_samples(per_sample: DataFrame, metadata: DataFrame) -> DataFrame:
    return per_sample.select("sample_id").distinct().join(metadata, "sample_id", "left_anti")


def require_metadata(per_sample: DataFrame, metadata: DataFrame) -> None:
    lost = [r.sample_id for r in missing_samples(per_sample, metadata).limit(5).collect()]
    if lost:
        raise ValueError(f"samples without metadata, among them {lost}")


def attach_metadata(per_sample: DataFrame, metadata: DataFrame, check: bool = True) -> DataFrame:
    """Left join on the sample; a table sample that has no metadata is an error, and so is a sample
    with different rows of metadata.

    No broadcast hint: Spark compares the size of the metadata with its threshold.
    """
    if check:
        require_metadata(per_sample, metadata)
    return per_sample.join(one_row_per(metadata, "sample_id", "metadata"), "sample_id", "left")


def match_lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                 value: str, order_by: list[str], name: str | None = None) -> DataFrame:
    """For each left row the value of the first right row with an equal key, else NULL.

    Rows are never multiplied; a NULL key meets a NULL key. ``order_by`` must order the
    right rows of a key completely. Repeated keys are reduced before the join.
    """
    name = name or value
    first = right.groupBy(F.col(right_key).alias("_k")).agg(
        F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order_by)).alias("_v"))
    joined = left.join(first, left[left_key].eqNullSafe(first["_k"]), "left")
    return joined.select(*[left[c] for c in left.columns if c != name], F.col("_v.v").alias(name))


def semi_keep(df: DataFrame, keep: DataFrame, key: str = "feature_id") -> DataFrame:
    return df.join(keep.select(key), key, "left_semi")


def removed(df: DataFrame, keep: DataFrame, key: str = "feature_id") -> DataFrame:
    return df.join(keep.select(key), key, "left_anti")


def strip_quotes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.replace(F.col(c), F.lit('"'), F.lit("")) for c in names})


def column_names(df: DataFrame) -> list[str]:
    return df.columns


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[df[f"`{n}`"] for n in names])


def assign_column(df: DataFrame, name: str, expression: Column) -> DataFrame:
    return df.withColumn(name, expression)


def head(df: DataFrame, order_by: list, n: int = 6) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def tabulate(*tables: DataFrame, key: str) -> DataFrame:
    """Tables with a common id column merged on it, in id order."""
    return reduce(lambda a, b: a.join(b, key), tables).orderBy(key)
