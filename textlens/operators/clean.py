"""From raw posts to cleaned posts and corpus lines."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.text import normalise
from textlens.operators.sampling import sample_per_group

# The attributes of a cleaned post.
REQUIRED = ["id", "text", "truncated", "lang", "created_at"]
COUNTS = ["quote_count", "reply_count", "retweet_count", "favorite_count"]
OPTIONAL = ["coordinates", "place", *COUNTS]


def clean_projection(posts: DataFrame) -> DataFrame:
    """Keep the post attributes only; a zero count is no count, a missing ``truncated`` is false."""
    have = set(posts.columns)
    kept = [F.coalesce("truncated", F.lit(False)).alias(c) if c == "truncated" else F.col(c) for c in REQUIRED if c in have]
    kept += [F.nullif(F.col(c), F.lit(0)).alias(c) if c in COUNTS else F.col(c) for c in OPTIONAL if c in have]
    others = [c for c in ("source_file", "bucket", "is_original") if c in have]
    return posts.select(*kept, *others)


def language_filter(posts: DataFrame, languages: Collection[str] = ("en",)) -> DataFrame:
    """Posts in one of the languages; no languages means no filter, an unknown language passes none."""
    return posts.filter(F.col("lang").isin(*languages)) if languages else posts


def valid_posts(posts: DataFrame, languages: Collection[str] = ("en",)) -> DataFrame:
    """Raw posts that have the keys ``id`` and ``text``, null values included, and no ``delete`` key.

    Expects the presence flags of `textlens.sources.posts.parse_posts`.
    """
    valid = posts.filter(F.col("has_id") & F.col("has_text") & ~F.col("has_delete"))
    return language_filter(valid, languages).drop("has_id", "has_text", "has_delete")


def expand_reposts(posts: DataFrame, keep_reposts: bool = False) -> DataFrame:
    """Replace each repost by its original, followed by the repost itself if it is to be kept.

    Originals are taken as they are, whatever their language, once for every repost.
    """
    nested = "retweeted_status"
    fields = posts.schema[nested].dataType.names
    others = [c for c in posts.columns if c not in fields and c != nested]
    own = F.struct(*[F.col(c) for c in fields])
    original = F.col(nested)
    itself = F.when(original.isNull() | F.lit(keep_reposts), own)
    chosen = F.filter(F.array(original, itself), lambda post: post.isNotNull())
    return posts.select(*others, F.posexplode(chosen).alias("_nth", "_post"), original.isNotNull().alias("_repost")).select(
        "_post.*", *others, (F.col("_repost") & (F.col("_nth") == 0)).alias("is_original")
    )


def clean_posts(posts: DataFrame, languages: Collection[str] = ("en",), keep_reposts: bool = False) -> DataFrame:
    """The whole cleaning step on parsed raw posts."""
    return clean_projection(expand_reposts(valid_posts(posts, languages), keep_reposts))


def make_corpus(
    posts: DataFrame,
    *,
    ignore_truncated: bool = False,
    phrases: Sequence[str] = (),
    proportion: float = 1.0,
    seed: int = 0,
    group: str = "source_file",
    key: str = "id",
    **steps: bool,
) -> DataFrame:
    """Normalised text of the posts that have one; ``steps`` are the switches of `normalise`."""
    kept = posts.filter(F.col("text").isNotNull())
    if ignore_truncated:
        kept = kept.filter(~F.coalesce("truncated", F.lit(False)))
    if proportion < 1.0:
        kept = sample_per_group(kept, group, [key], seed, proportion=max(0.0, proportion))
    return normalise(kept, "text", phrases=phrases, **steps)


def processing_summary(raw: DataFrame, cleaned: DataFrame, by: str = "bucket") -> DataFrame:
    """Files, posts and bytes before and after cleaning per ``by``, with a total row (``is_total``).

    Both inputs hold ``source_file, by, bytes`` per post.
    """
    sides = raw.select(by, "source_file", "bytes", F.lit(True).alias("_raw")).unionByName(
        cleaned.select(by, "source_file", "bytes", F.lit(False).alias("_raw"))
    )
    per_file = sides.groupBy(by, "source_file").agg(
        F.sum(F.when(F.col("_raw"), F.col("bytes")).otherwise(0)).alias("_raw_bytes"),
        F.sum(F.when(F.col("_raw"), 0).otherwise(F.col("bytes"))).alias("_clean_bytes"),
        F.count_if(F.col("_raw")).alias("_raw_posts"),
        F.count_if(~F.col("_raw")).alias("_clean_posts"),
    )
    return per_file.rollup(by).agg(
        (F.grouping(by) == 1).alias("is_total"),
        F.count(F.lit(1)).alias("files"),
        F.sum("_raw_bytes").alias("raw_bytes"),
        F.sum("_clean_bytes").alias("clean_bytes"),
        F.sum("_raw_posts").alias("raw_posts"),
        F.sum("_clean_posts").alias("clean_posts"),
    )
