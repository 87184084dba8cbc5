"""As-of join of two large tables: for each row the latest row of the other table at or before its time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.operators.joins import lookup_join
from textlens.session import materialise

SLICE_ROWS = 1 << 20
MOST_SLICES = 4096


def _below(time: Column, bounds: Column, count: int) -> Column:
    """How many of the sorted ``bounds``, at most ``count``, lie before ``time``, by halving steps."""
    jumps = F.array(*[F.lit(1 << bit) for bit in reversed(range(count.bit_length()))])

    def step(at: Column, jump: Column) -> Column:
        return F.when(F.get(bounds, at + jump - 1) < time, at + jump).otherwise(at)

    return F.aggregate(jumps, F.lit(0), step)


def _sliced(rows: DataFrame, keys: Sequence[str], slice_rows: int) -> tuple[DataFrame, bool]:
    """Adds ``_slice``: series of more than ``slice_rows`` rows are cut into ranges of time of about equal numbers of rows."""
    counts = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "series")
    most = counts.agg(F.max("_n")).first()[0] or 0
    if most <= slice_rows:
        return rows.withColumn("_slice", F.lit(0)), False
    slices = min(MOST_SLICES, -(-most // slice_rows))
    hot = counts.filter(F.col("_n") > slice_rows).select(*keys, F.lit(True).alias("_hot"))
    own = lookup_join(rows.select(*keys, "_time"), hot, keys)
    shares = [i / slices for i in range(1, slices)]
    # Rows of a series are summed up in parts first, so that no task reads a whole one.
    bounds = own.groupBy(*keys).agg(F.percentile_approx("_time", shares, 10 * slices).alias("_bounds"))
    placed = lookup_join(rows, materialise(bounds, "bounds"), keys, "left")
    return placed.withColumn("_slice", F.coalesce(_below(F.col("_time"), F.col("_bounds"), slices), F.lit(0))).drop("_bounds"), True


def asof_join(
    left: DataFrame,
    right: DataFrame,
    time: str,
    right_time: str,
    by: Sequence[str] = (),
    values: Sequence[str] | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every row of ``left`` with ``values`` of the latest row of ``right`` of the same ``by`` at or before its ``time``.

    ``values`` are columns of ``right``, by default all but ``by``. Rows without an earlier one have nulls, as have rows
    without ``time`` or ``by``. Of rows of ``right`` with the same time the one with the greatest ``values`` counts. Both
    tables should be stored: they are read for the sizes of the series and again for the join.

    Both sides are merged in order of time within each series, in one shuffle on the series. A series of more than
    ``slice_rows`` rows is cut into ranges of time, each merged by itself; what is still in force at the end of a range, one
    row, is carried into the next ones, so a series that holds a third of all rows is no hot spot.
    """
    by, kept = list(by), left.columns
    values = [c for c in right.columns if c not in by] if values is None else list(values)
    keys = [f"_by{i}" for i in range(len(by))] or ["_by"]

    def keyed() -> list[Column]:
        return [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias("_by")]

    def known(at: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [at, *by]])

    held, found = F.struct(*[F.col(c) for c in kept]), F.struct(*[F.col(c) for c in values])
    usable = right.filter(known(right_time)).select(*keyed(), F.col(right_time).alias("_time"), found.alias("_right"))
    asking = left.filter(known(time)).select(*keyed(), F.col(time).alias("_time"), held.alias("_left"))
    kinds = dict(usable.dtypes), dict(asking.dtypes)
    rows = asking.select(*keys, "_time", F.lit(1).alias("_side"), "_left", F.lit(None).cast(kinds[0]["_right"]).alias("_right"))
    rows = rows.union(usable.select(*keys, "_time", F.lit(0).alias("_side"), F.lit(None).cast(kinds[1]["_left"]).alias("_left"), "_right"))

    rows, cut = _sliced(rows, keys, slice_rows)
    order = Window.partitionBy(*keys, "_slice").orderBy("_time", "_side", "_right")
    latest = F.last("_right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = rows.withColumn("_found", latest).filter("_side = 1").select(*keys, "_slice", "_left", "_found")
    if cut:
        at = F.when(F.col("_side") == 0, F.struct("_time", "_right"))
        ends = rows.groupBy(*keys, "_slice").agg(F.max(at).alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(before)["_right"].alias("_carried"))
        carried = materialise(carried.filter(F.col("_carried").isNotNull()), "carried")
        merged = lookup_join(merged, carried, [*keys, "_slice"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    out = merged.select("_left.*", *[F.col("_found")[c].alias(c) for c in values])
    alone = left.filter(~known(time))
    return out.union(alone.select(*kept, *[F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in values]))
