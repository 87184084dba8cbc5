"""Global positions and running totals without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.session import materialise

CHUNK = 1 << 16
SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def global_index(df: DataFrame, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Number the rows from 0 in ``order``, which must leave no ties.

    Rows are range-partitioned, sorted within partitions and stored once. Only one count per partition
    is summed up centrally, so no task sees more than its own range.
    """
    stored = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", SLOT_BITS).alias("_part")
    counts = stored.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_slot").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within)
        .drop("_part", "_offset", "_slot")
    )


def running_total(df: DataFrame, index: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row, in the order of a dense ``index``.

    Windows run inside chunks of 65,536 rows; only one total per chunk is summed up centrally.
    """
    chunk = F.floor(F.col(index) / F.lit(CHUNK)).cast("bigint")
    parts = df.withColumn("_chunk", chunk)
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        parts.groupBy("_chunk")
        .agg(F.sum(value).alias("_total"))
        .select("_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_earlier"))
    )
    inside = Window.partitionBy("_chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.join(totals, "_chunk")
        .withColumn(name, F.col("_earlier") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_chunk", "_earlier")
    )
