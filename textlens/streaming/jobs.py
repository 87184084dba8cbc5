"""Continuous cleaning, running word counts and running stance.

The transformations take and return streaming frames; `run_available` drives one of them over all files
that have arrived and leaves the result in a table.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textlens.functions.text import normalise
from textlens.operators.clean import clean_posts
from textlens.operators.stance import CLASSES, stance_from_logits
from textlens.operators.temporal import weighted_mean
from textlens.operators.vocab import token_rows
from textlens.session import scratch_path
from textlens.sources.posts import parse_posts, with_bucket

# Names of Spark's settings.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stream_rows(spark: SparkSession, path: str, glob: str = "*.bz2", files_per_trigger: int = 1000) -> DataFrame:
    """Lines of arriving files as ``value, source_file``."""
    reader = (
        spark.readStream.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
    )
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))


def stream_clean(rows: DataFrame, languages: Collection[str] = ("en",), keep_reposts: bool = False) -> DataFrame:
    """Cleaned, dated posts of arriving lines; stateless."""
    return with_bucket(clean_posts(parse_posts(rows), languages, keep_reposts))


def running_word_counts(
    posts: DataFrame, delay: str = "1 day", every: str = "1 day", time: str = "created_ts", phrases: Sequence[str] = ()
) -> DataFrame:
    """Count of each word per window of ``every``; posts later than ``delay`` are dropped and their state with them."""
    texts = normalise(posts.select(time, "text"), "text", phrases=phrases)
    words = token_rows(texts.withWatermark(time, delay), [time])
    return _window_start(words.groupBy(F.window(time, every), "word").agg(F.count(F.lit(1)).alias("freq")))


def months_of(counts: DataFrame) -> DataFrame:
    """Roll daily counts up to months; streaming windows cannot span them."""
    return counts.groupBy(F.trunc("day", "month").alias("bucket"), "word").agg(F.sum("freq").alias("freq"))


def running_stance(
    posts: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    *,
    delay: str = "1 day",
    every: str = "1 day",
    time: str = "created_ts",
    classes: Sequence[int] = CLASSES,
    statistic: Callable[[Column, Column], Column] = weighted_mean,
) -> DataFrame:
    """Stance per window; ``score`` adds ``logits`` row by row."""
    scored = stance_from_logits(score(posts.withWatermark(time, delay)), classes)
    value = statistic(F.col("stance"), F.col("confidence")).alias("value")
    return _window_start(scored.groupBy(F.window(time, every)).agg(value))


def _window_start(counted: DataFrame) -> DataFrame:
    others = [c for c in counted.columns if c != "window"]
    return counted.select(F.to_date("window.start").alias("day"), *others)


def start(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the stream to a parquet table; files and state survive a restart from ``checkpoint``."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start(path)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on the executors' disks, and store what changed at each commit."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that has arrived and end; each micro-batch leaves its updated results below ``path``.

    Called again with the same ``checkpoint`` it goes on behind the last committed micro-batch, with the state and the
    watermark as they were. A micro-batch that is repeated replaces what it has left before.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_on_disk(stream.sparkSession):
        query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        query.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()


def read_updates(stream: DataFrame, path: str) -> DataFrame:
    """The latest results of all micro-batches of a `running_word_counts` or `running_stance`."""
    updates = stream.sparkSession.read.option("basePath", path).schema(f"{_ddl(stream)}, batch int").parquet(path)
    values = [c for c in stream.columns if c in ("freq", "value")]
    keys = [c for c in stream.columns if c not in values]
    latest = F.max_by(F.struct(*values), "batch").alias("_latest")
    return updates.groupBy(*keys).agg(latest).select(*keys, "_latest.*")


def run_available(stream: DataFrame, final: bool = False) -> DataFrame:
    """Process all that has arrived and read the result back.

    Windows that the watermark has not passed stay in the state; with ``final`` they are written too,
    as whole current results, batch by batch into a table of their latest rows.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    if not final:
        with state_on_disk(spark):
            start(stream, path, checkpoint, {"availableNow": True}).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    run_updates(stream, path, checkpoint)
    return read_updates(stream, path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
