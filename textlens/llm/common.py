"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.session import materialise

#: Word separators of the contracts, for regular expressions: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
BROADCAST_ROWS = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lost executors cost no earlier step."""
    return materialise(df, name)


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for what is costly to build (vocabularies)."""
    return sys.modules.setdefault("_textlens_llm_cache", types.ModuleType("_textlens_llm_cache")).__dict__


def map_columns(df: DataFrame, schema: str, make: Callable[[dict[str, list]], dict[str, object]], rows: int = 1000) -> DataFrame:
    """``df`` through ``make``, which turns columns of at most ``rows`` rows (as lists) into new columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = make({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([as_array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def as_array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind)
    if pa.types.is_list(kind) and len(values) and hasattr(values[0], "dtype"):
        import numpy as np

        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), kind.value_type), type=kind)
    return pa.array(values, kind)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table of narrow rows, marked for broadcast only if it was counted to be small."""
    return F.broadcast(df) if df.count() <= most else df


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than `SPACE`; null counts 0."""
    parts = F.size(F.split(text, SPACE + "+"))
    edges = text.rlike("^" + SPACE).cast("int") + text.rlike(SPACE + r"\z").cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(parts - edges).cast("bigint")


def bucket_of(*columns: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets))
