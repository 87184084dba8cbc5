"""Reproducible randomness: numbers that depend on the row's key only, not on its partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 4294967296.0  # 2 ** 32


def hash_int(seed: int | Column, *keys: Column) -> Column:
    """Integer in [0, 2^32) from the seed, which may differ by row, and the keys."""
    digest = F.md5(F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *[key.cast("string") for key in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed: int, *keys: Column) -> Column:
    """Number in [0, 1) from the seed and the keys."""
    return hash_int(seed, *keys) / F.lit(UNIT)
