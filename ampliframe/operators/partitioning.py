"""Gap-free numbering of a whole table, and joins on hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ampliframe.session import scratch_dir

def parts_of(df: DataFrame, rows: int) -> int:
    """How many parts give each about ``rows`` rows, at least one per core. The rows are counted."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """In parts of about ``rows`` rows, at least one per core. Rows that are cheap to move are dealt out before
    work that makes much of each: their files alone may give a handful of tasks, however many rows they have."""
    return df.repartition(parts_of(df, rows), *keys)


# monotonically_increasing_id puts the partition number above this many low bits.
ROW_BITS = 33


def _placed(df: DataFrame) -> DataFrame:
    """Checkpointed, so partitions stay as they are; adds the partition (``_part``) and the place
    in it (``_row``)."""
    scratch_dir(df.sparkSession)
    places = df.checkpoint().withColumn("_at", F.monotonically_increasing_id())
    return places.select("*", F.shiftright("_at", ROW_BITS).alias("_part"),
                         F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row")).drop("_at")


def _before_parts(sizes: DataFrame) -> DataFrame:
    """Sum of the sizes of all earlier partitions; one row per partition."""
    return sizes.withColumn(
        "_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size"))


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Number the rows 0, 1, 2, … as they stand (sorted before).

    A row's number is its place inside its partition plus the size of the partitions before. Only
    one row per partition is windowed, never the table.
    """
    places = _placed(df)
    before = _before_parts(places.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")))
    return (places.join(before, "_part")
            .withColumn(name, F.col("_row") + F.col("_before"))
            .select(*df.columns, name))


def global_index(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """Number rows 0, 1, 2, … in the order of ``order_by`` (a unique key)."""
    return number_rows(df.orderBy(*order_by), name)


# Buckets that values are counted in: so many per factor of e, both signs.
BUCKETS_PER_E = 256


def weighted_quantiles(counted: DataFrame, value: str, weight: str, fractions: dict[str, float],
                       by: list[str] | None = None) -> DataFrame:
    """Exact quantiles (linear between neighbours) of ``value``, each present ``weight`` times, per group
    ``by``: one row per group (without ``by`` one row), a column per named fraction. Groups without values have none.

    A plan without jobs of its own. Values are counted in buckets that keep their order (some thousand
    rows); running sums over buckets tell which ones hold the wanted ranks, and only values of these are
    ordered.
    """
    by = by or []
    size = F.floor(F.ln(1 + F.abs(F.col("_v"))) * BUCKETS_PER_E)
    rows = counted.filter(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("_v"), F.col(weight).alias("_w")).withColumn("_bucket", F.signum("_v").cast("long") * size)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    buckets = rows.groupBy(*by, "_bucket").agg(F.sum("_w").alias("_size")).select(
        *by, "_bucket", "_size", (F.sum("_size").over(group.orderBy("_bucket")) - F.col("_size")).alias("_before"),
        F.sum("_size").over(group).alias("_total"))
    names = list(fractions)
    wanted = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(up).alias("_up"), F.lit(f).alias("_f"))
                       for i, f in enumerate(fractions.values()) for up in (False, True)])
    spot = (F.col("_total") - 1) * F.col("_f")
    # Two rows per fraction and group.
    ranks = buckets.select("*", F.inline(wanted)).withColumn(
        "_rank", F.when(F.col("_up"), F.ceil(spot)).otherwise(F.floor(spot))).filter(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size")))
    keys = [*by, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy("_v")
    ordered = rows.join(ranks.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "_v").agg(F.sum("_w").alias("_w")).withColumn(
        "_to", F.sum("_w").over(inside))
    at = ranks.join(ordered, keys).filter(
        (F.col("_rank") < F.col("_before") + F.col("_to")) & (F.col("_rank") >= F.col("_before") + F.col("_to") - F.col("_w")))

    def quantile(i: int, f: float) -> Column:
        low, high = (F.max(F.when((F.col("_i") == i) & (F.col("_up") == up), F.col("_v"))) for up in (False, True))
        place = (F.max("_total") - 1) * F.lit(f)
        return low + (high - low) * (place - F.floor(place))

    return at.groupBy(*by).agg(*[quantile(i, fractions[n]).alias(n) for i, n in enumerate(names)])


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 16,
                how: str = "inner") -> DataFrame:
    """Equi-join where a key may hold a large share of ``big``.

    The rows of a key of ``big`` spread over ``salts`` tasks by a hash of the whole row; the
    rows of ``small`` (few per key) are repeated once per salt. No row is lost.

    A sort-merge join is asked for: Spark's size estimate does not see how far the rows were
    multiplied before, and might broadcast far more than its threshold.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread.hint("merge"), [*keys, "_salt"], how).drop("_salt")
