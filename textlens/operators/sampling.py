"""Exact, reproducible samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.functions.hashing import hash_uniform
from textlens.operators.joins import lookup_join
from textlens.session import materialise


def sample_per_group(
    df: DataFrame,
    group: str,
    keys: Sequence[str],
    seed: int,
    *,
    proportion: float | None = None,
    size: int | None = None,
) -> DataFrame:
    """Exactly ``floor(n * proportion)`` or ``size`` rows of each group, uniformly without replacement.

    Rows are drawn by their hash. A group of n rows is cut into sqrt(n) hash cells; counting the cells
    tells which of them are taken whole and which one is taken in part, and only that one is sorted.
    So a group that holds most of the rows is never gathered in one task. Rows without a group are one.
    """
    if (proportion is None) == (size is None):
        raise ValueError("give either a proportion or a size")
    kept = df.columns
    df = df.withColumn("_group", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null")))
    taken = F.floor(F.col("_n") * F.lit(proportion)) if size is None else F.least("_n", F.lit(size))
    groups = materialise(
        df.groupBy("_group")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_group", taken.cast("bigint").alias("_take"), F.ceil(F.sqrt("_n")).cast("bigint").alias("_cells"))
    )
    drawn = df.withColumn("_u", hash_uniform(seed, *[F.col(key) for key in keys]))
    cell = F.floor(F.col("_u") * F.col("_cells")).cast("bigint")

    light = drawn.select("_group", *keys, "_u")
    cells = lookup_join(light, groups, ["_group"]).groupBy("_group", "_take", "_cells", cell.alias("_cell"))
    upto = Window.partitionBy("_group").orderBy("_cell")
    counted = cells.agg(F.count(F.lit(1)).alias("_in")).withColumn("_upto", F.sum("_in").over(upto))
    edge = materialise(
        counted.filter((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_in") < F.col("_take"))).select(
            "_group", "_cells", F.col("_cell").alias("_edge"), (F.col("_take") - F.col("_upto") + F.col("_in")).alias("_need")
        )
    )

    placed = lookup_join(drawn, edge, ["_group"]).withColumn("_cell", cell)
    whole = placed.filter(F.col("_cell") < F.col("_edge")).select(*kept)
    order = Window.partitionBy("_group").orderBy("_u", *keys)
    part = (
        placed.filter(F.col("_cell") == F.col("_edge"))
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= F.col("_need"))
        .select(*kept)
    )
    return whole.unionByName(part)


def split_dataset(df: DataFrame, keys: Sequence[str], seed: int, validation: float = 0.2, test: float = 0.0) -> DataFrame:
    """Add ``part``: test, validation or train, decided by the row's key alone."""
    u = hash_uniform(seed, *[F.col(key) for key in keys])
    part = (
        F.when(u < F.lit(test), F.lit("test"))
        .when(u < F.lit(test) + (F.lit(1.0) - F.lit(test)) * F.lit(validation), F.lit("validation"))
        .otherwise(F.lit("train"))
    )
    return df.withColumn("part", part)
