"""Series over time buckets. A bucket without the word is absent from its series, never zero."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.vector import cosine
from textlens.operators.asof import asof_join
from textlens.operators.joins import lookup_join
from textlens.operators.ranking import global_index
from textlens.operators.vocab import word_counts
from textlens.session import materialise


def term_frequency(
    tokens: DataFrame,
    words: Sequence[str] | None = None,
    *,
    min_frequency: int = 0,
    max_tokens: int | None = None,
    bucket: str = "bucket",
    order: str | None = None,
) -> DataFrame:
    """Mentions of each word per bucket and their share of the bucket's words: ``mentions, proportion``.

    Each bucket has its own vocabulary, cut by frequency and size; its corpus size counts the kept words.
    Ties at the cut go by ``order``, a column of first appearance, or by the word. The counts are stored
    once, and a bucket that holds most of them is neither ranked nor joined in one task.
    """
    kept = _bucket_counts(tokens, bucket, order).filter(F.col("freq") >= min_frequency)
    if max_tokens is None:
        kept = materialise(kept.drop("_tie"))
    else:
        placed = global_index(kept, [F.col(bucket).asc(), F.col("freq").desc(), F.col("_tie").asc()], "_place")
        starts = placed.groupBy(bucket).agg(F.min("_place").alias("_start"))
        kept = lookup_join(placed, starts, [bucket]).filter(F.col("_place") - F.col("_start") < max_tokens)
    sizes = kept.groupBy(bucket).agg(F.sum("freq").alias("corpus_size"))
    chosen = kept if words is None else kept.filter(F.col("word").isin(*words))
    return lookup_join(chosen, sizes, [bucket]).select(
        bucket, "word", F.col("freq").alias("mentions"), (F.col("freq") / F.col("corpus_size")).alias("proportion")
    )


def _bucket_counts(tokens: DataFrame, bucket: str, order: str | None) -> DataFrame:
    if order is None:
        return word_counts(tokens, [bucket]).withColumn("_tie", F.col("word"))
    return tokens.groupBy(bucket, "word").agg(F.count(F.lit(1)).alias("freq"), F.min(order).alias("_tie"))


def similarity_over_time(spaces: DataFrame, word_a: str, word_b: str, bucket: str = "bucket") -> DataFrame:
    """Cosine of two words in every bucket whose space holds both."""
    a = spaces.filter(F.col("word") == word_a).select(bucket, F.col("vec").alias("_u"))
    b = spaces.filter(F.col("word") == word_b).select(bucket, F.col("vec").alias("_v"))
    return a.join(b, bucket).select(bucket, cosine(F.col("_u"), F.col("_v")).alias("similarity"))


def weighted_mean(stance: Column, confidence: Column) -> Column:
    """Mean of stance times confidence."""
    return F.sum(stance * confidence) / F.count(stance)


def stance_by_bucket(
    scored: DataFrame, statistic: Callable[[Column, Column], Column] = weighted_mean, bucket: str = "bucket"
) -> DataFrame:
    """Summary of ``stance`` and ``confidence`` per bucket; ``statistic`` returns an aggregate column."""
    return scored.groupBy(bucket).agg(statistic(F.col("stance"), F.col("confidence")).alias("value"))


def entity_trend(survey: DataFrame, rise: float | None = None) -> DataFrame:
    """Last less first ``prop`` of each entity, those with at least ``rise`` if it is given."""
    trend = survey.groupBy("entity").agg((F.max_by("prop", "year") - F.min_by("prop", "year")).alias("change"))
    return trend if rise is None else trend.filter(F.col("change") >= rise)


def event_overlay(series: DataFrame, events: DataFrame, window: int = 1, bucket: str = "bucket", **options: object) -> DataFrame:
    """Latest event at or before the end of each month of a series, with the mean ``value`` of the ``window``
    months before the event's month and of as many from it on.

    ``series`` has ``series, bucket, value``; ``events`` has ``day, event``. Both may be large: the event is found by an
    `asof_join` (which takes ``options``), and the means by one row per series, event and month around it.
    """
    by_month = events.groupBy(F.trunc("day", "month").alias("_month")).agg(F.max("day").alias("day"), F.max_by("event", "day").alias("event"))
    by_month = materialise(by_month, "events")
    ended = series.select("series", bucket, "value", F.last_day(bucket).alias("_end"))
    marked = asof_join(ended, by_month, "_end", "day", values=["day", "event"], **options).drop("_end")

    offsets = F.sequence(F.lit(-window), F.lit(window - 1))
    around = by_month.select("day", "_month", F.explode(offsets).alias("_offset")).withColumn(
        bucket, F.add_months("_month", F.col("_offset"))
    )
    near = around.groupBy(bucket).agg(F.collect_list(F.struct("day", "_offset")).alias("_near"))  # at most 2 * window
    met = lookup_join(series, near, [bucket]).select("series", "value", F.explode("_near").alias("_near"))
    means = met.groupBy("series", F.col("_near.day").alias("day")).agg(
        F.avg(F.when(F.col("_near._offset") < 0, F.col("value"))).alias("mean_before"),
        F.avg(F.when(F.col("_near._offset") >= 0, F.col("value"))).alias("mean_after"),
    )
    return marked.join(means, ["series", "day"], "left").select("series", bucket, "value", "day", "event", "mean_before", "mean_after")
