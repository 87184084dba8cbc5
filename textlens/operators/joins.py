"""Key lookups that hold when the table is large or one key owns much of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1 / 64
SALTS = 64


def _width(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + F.lit(24)
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.size(F.col(field.name)), F.lit(0)) * F.lit(16) + F.lit(24)
    return F.lit(16)


def bytes_of(df: DataFrame) -> Column:
    """Size of rows of ``df`` in memory, as an aggregate."""
    return F.sum(reduce(lambda a, b: a + b, [_width(field) for field in df.schema.fields]).cast("bigint"))


def table_bytes(df: DataFrame) -> int:
    """Size of ``df`` in memory, from one aggregation over it."""
    return int(df.agg(bytes_of(df)).first()[0] or 0)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    right_bytes: int | None = None,
) -> DataFrame:
    """Join each row of ``left`` to the one row of ``right`` with its key.

    ``right`` must hold each key once and be cheap to read twice. It is broadcast only if its size, measured
    here unless the caller knows it, is small; a larger table is joined by shuffle with the hot keys of
    ``left`` spread over salts.
    """
    keys = list(keys)
    if (table_bytes(right) if right_bytes is None else right_bytes) <= max_bytes:
        return left.join(F.broadcast(right), keys, how)
    return salted_lookup_join(left, right, keys, how)


def salted_lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """The shuffle form of `lookup_join`: rows of a key that owns over 1/64 of ``left`` are spread
    over 64 salts, and only those keys' rows of ``right`` are repeated. At most 64 keys can be hot.
    """
    keys = list(keys)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.filter(F.col("_n") > total * HOT_SHARE).select(*keys, F.lit(True).alias("_hot"))
    hashable = [F.col(name) for name, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    spread = F.pmod(F.xxhash64(*hashable), F.lit(SALTS)).cast("int")
    no_key = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])
    tagged = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_hot") | no_key, spread).otherwise(F.lit(0)))
        .drop("_hot")
    )
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    repeated = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return tagged.join(repeated, [*keys, "_salt"], how).drop("_salt")
