"""Distributed row numbering over a total order.

``Window.orderBy(...)`` without ``partitionBy`` pulls every row into one task.
``global_row_number`` instead range-partitions on the full order (the range
partitioner splits even a hot value when the order has a tiebreak), numbers
rows inside each partition, materialises that once in the shared checkpoint
folder, and adds per-partition prefix offsets from a table with one row per
partition (bounded by the partition count, so broadcasting it is safe).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _cols(order):
    return [F.col(c) if isinstance(c, str) else c for c in order]


def global_row_number(df: DataFrame, order: list, name: str = "rn",
                      num_partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Append a 1-based row number following ``order`` (must be a total order).

    ``total`` names an optional column with the row count, taken from the same
    per-partition counts (no second pass over the input)."""
    order = _cols(order)
    # without an explicit count AQE sizes the range partitions to the data (adjacent
    # ranges are merged, so partition order still follows the sort order)
    n = num_partitions
    ranged = (df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    # monotonically_increasing_id = (partition index << 33) + position in partition
    local = ranged.withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    local = cut_lineage(local)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_tot", F.sum("_cnt").over(Window.partitionBy(F.lit(1)))).select("_pid", "_off", "_tot")
    out = local.join(F.broadcast(offsets), "_pid") \
        .withColumn(name, F.col("_off") + F.col("_pos") + 1)
    if total:
        out = out.withColumnRenamed("_tot", total)
    return out.drop("_pid", "_pos", "_off", "_tot")


def group_lag(df: DataFrame, groups: list[str], order: list, col: str, name: str,
              num_partitions: int | None = None) -> DataFrame:
    """``lag(col) over (partition by groups order by order)`` without putting a whole group in one task.

    Rows are range-partitioned on (groups, order) — a group holding a third of
    all rows is spread over many tasks — and the lag is taken inside each
    (partition, group) piece. The first row of a piece takes the last value of
    the same group in the nearest earlier partition, found on a table with one
    row per (partition, group piece).
    """
    keys = [F.col(g) for g in groups] + _cols(order)
    n = num_partitions
    ranged = (df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    local = ranged.withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    local = cut_lineage(local)
    piece = Window.partitionBy("_pid", *groups).orderBy("_pos")
    local = local.withColumn(name, F.lag(col).over(piece)).withColumn("_first", F.row_number().over(piece) == 1)
    lasts = local.groupBy("_pid", *groups).agg(F.max_by(col, "_pos").alias("_last"))
    prev = lasts.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*groups).orderBy("_pid"))) \
        .select("_pid", *groups, "_prev")
    out = local.join(prev, ["_pid", *groups], "left")
    return out.withColumn(name, F.when(F.col("_first"), F.col("_prev")).otherwise(F.col(name))) \
        .drop("_pid", "_pos", "_first", "_prev")
