"""Global row numbers without a single-partition window (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.plans.staging import staged

#: monotonically_increasing_id keeps the row's place in its partition in the low 33 bits.
_PLACE = (1 << 33) - 1


def _in_ranges(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` staged in ranges of the order, with ``_part`` and the row's ``_place`` in its range."""
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    names = [f"_o{i}" for i in range(len(order))]
    placed = (
        keyed.repartitionByRange(*names)
        .sortWithinPartitions(*names)
        .withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))})
        .drop(*names)
    )
    return staged(placed, label)


def _before_ranges(ranges: DataFrame, total: str) -> DataFrame:
    """(_part, _n) of each range -> what lies before it and in all; one row per range."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias(total))


def ranked(df: DataFrame, order: list[Column], label: str, rank: str = "rank", total: str = "n_rows") -> DataFrame:
    """``df`` with ``rank`` (0-based place in the order) and ``total`` (number of rows), both long.

    One range shuffle on the order columns, a sort inside each range, and the place of each row
    in its range; the table is staged once. Rows before each range are then a running sum over
    one row per range (their number is the number of shuffle partitions), which is broadcast.
    Give an order that ends in a near-unique column: a hot leading value is then split over
    ranges. Rows that tie in all order columns get distinct ranks in any order. The range shuffle
    looks at ``df`` twice (once to sample), so stage it before if it is dear to make.
    """
    table = _in_ranges(df, order, label)
    ranges = _before_ranges(table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), total)
    return table.join(F.broadcast(ranges), "_part").withColumn(rank, F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


def running_total(df: DataFrame, order: list[Column], value: str, label: str, before: str, total: str) -> DataFrame:
    """``df`` with the sums of ``value`` over the rows ``before`` each in the order, and in all."""
    table = _in_ranges(df, order, label)
    ranges = _before_ranges(table.groupBy("_part").agg(F.sum(value).alias("_n")), total)
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    joined = table.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(ranges), "_part")
    return joined.withColumn(before, F.col("_base") + F.col("_own")).drop("_part", "_place", "_base", "_own")
