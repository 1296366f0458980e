"""Surrogate keys without a single-task window.

``assign_keys`` numbers rows 1..N in the order of a unique key tuple, offset
by a base (the sequence's current value).  Rows are range-partitioned by the
key (balanced by sampling, so no hot partition for unique keys), numbered
inside each partition, and shifted by the row counts of the preceding
partitions; that offset table has one row per partition, so its broadcast is
bounded by the partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilebook.session import landed


def assign_keys(df: DataFrame, order: list[str], base: Column, out: str,
                partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    pos = ranged.withColumn("__pid", F.spark_partition_id()).withColumn(
        "__local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    # The range partitioner samples with a seed tied to the RDD id, so two
    # recomputations of the exchange may cut the data differently.  Both the
    # partition counts and the rows must see one cut: land it once in the
    # shared folder (survives executor loss; its shuffle files go).
    pos = landed(pos, "numbered")
    counts = pos.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    numbered = pos.join(F.broadcast(offsets), "__pid")
    return numbered.withColumn(out, base + F.col("__off") + F.col("__local") + F.lit(1)).drop(
        "__pid", "__local", "__off")


def current_max(existing: DataFrame, col: str) -> Column:
    """``max(existing.col)`` (0 if empty) as a scalar subquery: the current
    value of a sequence whose numbers are the column's values."""
    return existing.agg(F.coalesce(F.max(col), F.lit(0)).cast("long")).scalar()


def with_base(df: DataFrame, existing: DataFrame, col: str, out: str = "__base") -> DataFrame:
    """Attach the current sequence value (see :func:`current_max`) to every row."""
    return df.withColumn(out, current_max(existing, col))


def rank_within(df: DataFrame, group: list[str], order: list[str], out: str = "RN") -> DataFrame:
    """1-based position of each row inside its group, in ``order`` (row_number).

    No group is ever gathered in one task: rows are numbered globally in
    (group, order) sequence by :func:`assign_keys` (a range shuffle that cuts
    a hot group across partitions), and each row subtracts its group's first
    global number, found by a partial-aggregated ``min``.  Rows identical in
    every ordering column get consecutive numbers in arbitrary order; they
    are indistinguishable in the output.
    """
    numbered = assign_keys(df, group + order, F.lit(0).cast("long"), "__gpos")
    first = numbered.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(
        F.min("__gpos").alias("__gfirst"))
    cond = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    joined = numbered.join(first, cond).drop(*[f"__g{i}" for i in range(len(group))])
    return joined.withColumn(out, F.col("__gpos") - F.col("__gfirst") + F.lit(1)).drop("__gpos", "__gfirst")


def top_n_pivot(df: DataFrame, group: list[str], order: list[str], value, n: int, prefix: str) -> DataFrame:
    """First ``n`` values per group as columns ``prefix1..prefixN`` (bounded pivot).

    ``row_number() <= n`` over a group window: Spark plans a partial
    WindowGroupLimit before the shuffle, so each map task forwards at most
    ``n`` rows per group and a hot group never reaches one task whole.
    ``value`` must be determined by ``group`` + ``order`` (ties then agree).
    """
    val = value if not isinstance(value, str) else F.col(value)
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.select(*group, *order, val.alias("__val")).withColumn("RN", F.row_number().over(w))
    ranked = ranked.filter(F.col("RN") <= n)
    return ranked.groupBy(*group).agg(*[F.max(F.when(F.col("RN") == i, F.col("__val"))).alias(f"{prefix}{i}")
                                        for i in range(1, n + 1)])
